"""Character classes of the cleaning steps: members over all code points, and what a text of ASCII costs."""

import time

from rolecast.functions.regex import SPACE, rx
from rolecast.functions.text import FORBIDDEN, NFKC_STABLE

MEMBERS = {
    f"[{SPACE}]": r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]",
    f"[^{SPACE}]": r"[^\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]",
    f"[{SPACE}&&[^\\n]]": r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}&&[^\n]]",
    rx(r"[^\s)]"): r"(?i)[^\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF})]",
    f"[^{NFKC_STABLE}]": r"[^\x00-\x7F\xC0-\xFF\x{2013}\x{2014}\x{2018}-\x{201D}\x{2022}\x{20AC}\x{20B9}]",
    FORBIDDEN: r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]",
    rx(r"\ba"): "(?i)(?<![A-Za-z0-9_])a",
    rx(r"a\b"): "(?i)a(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))",
}


def test_members(spark):
    every = " ".join(f"{chr(c)}a{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    pattern = spark._jvm.java.util.regex.Pattern
    for new, plain in MEMBERS.items():
        assert pattern.compile(new).matcher(every).replaceAll("") == pattern.compile(plain).matcher(every).replaceAll(""), new


def test_ascii_is_settled_at_once(spark):
    """Each class reads ASCII clearly faster than its members one after the other."""
    pattern, text = spark._jvm.java.util.regex.Pattern, "plainwords" * 400_000
    for new in (f"[{SPACE}&&[^\\n]]", FORBIDDEN):
        best = {new: 9e9, MEMBERS[new]: 9e9}
        for _ in range(4):
            for one in best:
                found = pattern.compile(one).matcher(text)
                start = time.perf_counter()
                assert not found.find()
                best[one] = min(best[one], time.perf_counter() - start)
        assert best[new] * 1.5 < best[MEMBERS[new]], (new, best)
