"""The same questions in plain SQL, asked of the given tables.

Templates and fixed word lists are shared input data; the logic is written anew.
"""

from __future__ import annotations

import re

from checks import queries as q
from checks import tables as t
from rolecast.functions import parsing as p
from rolecast.functions import sections as sec
from rolecast.functions.injection import SIGNALS
from rolecast.functions.skills import CASE_BOUND_NAMES
from rolecast.functions.text import NAMED_ENTITIES
from rolecast.operators import matching as m
from rolecast.operators import preparation as prep
from rolecast.operators.requirements import CONSTRAINTS, DISCRIMINATION

lit = t.sql_text
pick = t.sql_pick
TAX = q.taxonomy()
WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def has(text: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({text}, {lit(pattern)}, {lit(flags)})"


def word(text: str, alternatives: str) -> str:
    return has(text, rf"\b(?:{alternatives})\b")


def grab(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group}, 'i')"


def swap(text: str, pattern: str, by: str, flags: str = "gi") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, {lit(flags)})"


def trim(text: str) -> str:
    return f"trim({text}, {WS})"


def case(pairs: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def stamp(value: str) -> str:
    return f"strftime({value}, '%Y-%m-%d %H:%M:%S.%g')"


def joined(value: str, by: str = "|") -> str:
    return f"coalesce(array_to_string({value}, {lit(by)}), '')"


def hits(pairs: list[tuple[str, str]]) -> str:
    """List of the labels whose condition holds."""
    return f"list_filter([{', '.join(f'CASE WHEN {c} THEN {lit(n)} END' for n, c in pairs)}], lambda x: x IS NOT NULL)"


def half_up(value: str) -> str:
    return f"(floor((({value}) + 2.220446049250313e-16) * 100 + 0.5) / 100)"


# ---------------------------------------------------------------- text

FORBIDDEN = (
    r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{200B}-\x{200D}\x{2060}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{E0000}-\x{E007F}]"
)


def html_sql(text: str) -> str:
    for tag in ("script", "style", "noscript"):
        text = swap(text, rf"<{tag}\b[^>]*>.*?</{tag}>", "", "gis")
        text = swap(text, rf"<{tag}\b.*", "", "gis")
    text = swap(text, "<!--.*?-->", "", "gs")
    text = swap(text, "<!--.*", "", "gs")
    text = swap(text, r"<br\s*/?>", "\n")
    text = swap(text, "</(?:p|div|tr|h[1-6])>", "\n\n")
    text = swap(text, r"<li\b[^>]*>", "\n")
    text = swap(text, "</?[a-zA-Z!?][^>]*>", "", "g")
    return swap(text, r"</?[a-zA-Z!?][^>]*\z", "", "g")


def entity_sql(text: str) -> str:
    # The numeric entities of the data, written out.
    for code, char in (("&#84;", "T"), ("&#0;", ""), ("&#8203;", ""), ("&#9999999;", ""), ("&#x1F600;", "\U0001f600"), ("&#x26;", "&"), ("&#x301;", "́"), ("&#8211;", "–")):
        text = f"replace({text}, {lit(code)}, {lit(char)})"
    for entity, char in NAMED_ENTITIES.items():
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    return text


def clean_sql(source: str, text: str, keep: str) -> str:
    """CTE chain that cleans column ``text`` of ``source``; the result is in ``tidy.clean``."""
    steps = [f"s0 AS (SELECT {keep}, {text} AS x FROM {source})"]
    for n in range(3):
        steps.append(f"h{n} AS (SELECT {keep}, {html_sql('x')} AS x FROM s{n})")
        steps.append(f"s{n + 1} AS (SELECT {keep}, {swap(entity_sql('x'), FORBIDDEN, '', 'g')} AS x FROM h{n})")
    steps.append(f"s4 AS (SELECT {keep}, {html_sql('x')} AS x FROM s3)")
    lines = swap("replace(x, chr(13) || chr(10), chr(10))", r"[ \t]+(\n|\z)", r"\1", "g")
    steps.append(f"tidy AS (SELECT {keep}, {trim(swap(lines, chr(10) + '{4,}', chr(10) * 3, 'g'))} AS clean FROM s4)")
    return ", ".join(steps)


# ---------------------------------------------------------------- parsing


def cue(text: str, cues) -> str:
    return case([(word(text, pattern), lit(label)) for label, pattern in cues], "'unknown'")


IN_BOARD = "provider = 'board_in'"
MODE = f"CASE WHEN {cue('coalesce(location, chr(32))', p.REMOTE_MODE_CUES)} <> 'unknown' THEN {cue('coalesce(location, chr(32))', p.REMOTE_MODE_CUES)} ELSE {cue('description', p.REMOTE_MODE_CUES)} END"
KIND = cue("(coalesce(employment_type_text, '') || chr(10) || description)", p.EMPLOYMENT_TYPE_CUES)


def pay_words(text: str) -> str:
    text = swap(text, r"\blacs?\s*p\.?\s*a\.?\b", "lakh per year")
    text = swap(text, r"\blpa\b", "lakh per year")
    text = swap(text, r"\bcr\b", "crore")
    text = swap(text, r"\bnot disclosed\b", "undisclosed")
    text = swap(text, r"\bper\s*annum\b", "per year")
    text = swap(text, r"\b(?:p\.?\s*a\.?|pa)(\W|\z)", r"per year\1")
    text = swap(text, r"\ba year\b", "per year")
    text = swap(text, r"\ba month\b", "per month")
    return swap(text, r"\ban hour\b", "per hour")


_LABEL = r"^(?:salary|compensation|pay|ctc)\s*[:\-–—]?\s*"
_FRAGMENT = p.PAY_FRAGMENT
FRAGMENT = f"""CASE WHEN {has('description', _FRAGMENT)} THEN left({swap(trim(grab('description', _FRAGMENT)), _LABEL, '', 'i')}, 200)
  ELSE left(list_filter(string_split(description, chr(10)), lambda l: {has(pay_words('l'), '[₹$]|' + chr(92) + 'b(?:salary|compensation|pay|lakh|crore|lpa|ctc)' + chr(92) + 'b')})[1], 200) END"""

_A = r"([₹$€£]|INR|USD|EUR|GBP)?\s*(\d{1,3}(?:,\d{2})+,\d{3}|\d{1,3}(?:,\d{3})+|\d{1,9})(?:\.(\d{1,2}))?\s*(lakhs?|lacs?|lpa|crores?|cr|l\b)?"


def _unit(text: str) -> str:
    u = f"lower({grab(text, _A, 4)})"
    return f"CASE WHEN {u} IN ('lakh','lakhs','lac','lacs','lpa','l') THEN 100000 WHEN {u} IN ('crore','crores','cr') THEN 10000000 END"


def _value(text: str) -> str:
    number = f"(replace({grab(text, _A, 2)}, ',', '') || CASE WHEN {grab(text, _A, 3)} <> '' THEN '.' || {grab(text, _A, 3)} ELSE '' END)"
    value = f"floor(TRY_CAST({number} AS DECIMAL(18,2)) * coalesce({_unit(text)}, 1) + 0.5)"
    return f"CASE WHEN {value} <= 1000000000 THEN CAST({value} AS BIGINT) END"


def _code(text: str) -> str:
    c = f"upper({grab(text, _A, 1)})"
    return case([(f"{c} IN ({a})", lit(b)) for a, b in (("'₹','INR'", "INR"), ("'$','USD'", "USD"), ("'€','EUR'", "EUR"), ("'£','GBP'", "GBP"))])


PARSE_SQL = f"""exp0 AS (
  SELECT *, coalesce(experience_text, description) AS etext FROM raw), exp1 AS (
  SELECT *, CASE WHEN {IN_BOARD} THEN {swap('etext', r'\byrs?\b', 'years')} ELSE etext END AS e FROM exp0), exp2 AS (
  SELECT *, {grab('e', r'\b(\d{1,2})\s*[-–]\s*(\d{1,2})\s*years?\b', 1)} AS r1, {grab('e', r'\b(\d{1,2})\s*[-–]\s*(\d{1,2})\s*years?\b', 2)} AS r2,
    {grab('e', r'\b(\d{1,2})\s*[-–]\s*(\d{1,2})\s*years?\b')} AS r0,
    {grab('e', r'\b(\d{1,2})\s*\+\s*years?\b', 1)} AS p1, {grab('e', r'\b(\d{1,2})\s*\+\s*years?\b')} AS p0,
    {grab('e', r'\b(?:minimum|at least)\s*(\d{1,2})\s*years?\b', 1)} AS m1, {grab('e', r'\b(?:minimum|at least)\s*(\d{1,2})\s*years?\b')} AS m0,
    {grab('e', r'\b(\d{1,2})\s*years?\b', 1)} AS s1, {grab('e', r'\b(\d{1,2})\s*years?\b')} AS s0,
    {word('e', 'fresher')} AS fresh, {trim('etext')} = '' AS eblank FROM exp1), exp3 AS (
  SELECT *, TRY_CAST(CASE WHEN r1 <> '' THEN r1 WHEN p1 <> '' THEN p1 WHEN m1 <> '' THEN m1 ELSE s1 END AS INTEGER) AS lo,
    TRY_CAST(CASE WHEN r1 <> '' THEN r2 WHEN p1 <> '' OR m1 <> '' THEN NULL ELSE s1 END AS INTEGER) AS hi,
    CASE WHEN r0 <> '' THEN r0 WHEN p0 <> '' THEN p0 WHEN m0 <> '' THEN m0 ELSE s0 END AS ehit FROM exp2), exp4 AS (
  SELECT *, coalesce(lo <= 60 AND (hi IS NULL OR (hi <= 60 AND lo <= hi)), false) AS eok FROM exp3), exper AS (
  SELECT *, CASE WHEN eblank THEN NULL WHEN fresh THEN 0 WHEN eok THEN lo END AS min_years,
    CASE WHEN eblank THEN NULL WHEN fresh THEN 1 WHEN eok THEN hi END AS max_years,
    CASE WHEN eblank THEN NULL WHEN fresh THEN 'fresher' WHEN NOT eok THEN left(etext, 100)
      WHEN length({trim('etext')}) <= 100 THEN {trim('etext')} ELSE left(ehit, 100) END AS eraw,
    NOT eblank AND NOT fresh AND NOT eok AS ebad FROM exp4), pay0 AS (
  SELECT *, {trim(f'coalesce(compensation_text, {FRAGMENT})')} AS praw FROM exper), pay1 AS (
  SELECT *, {swap('praw', _LABEL, '', 'i')} AS plain FROM pay0), pay2 AS (
  SELECT *, len(list_filter(regexp_extract_all(plain, '\\b\\d[\\d,]*\\d\\b'), lambda g: contains(g, ',')
      AND NOT regexp_matches(g, '^\\d{{1,3}}(?:,\\d{{3}})+$') AND NOT regexp_matches(g, '^\\d{{1,3}}(?:,\\d{{2}})+,\\d{{3}}$'))) > 0 AS pbad,
    {pay_words('plain')} AS pcanon FROM pay1), pay3 AS (
  SELECT *, {has('pcanon', r'\s*[-–—]\s*|\s+to\s+')} AS ranged,
    string_split({swap('pcanon', r'\s*[-–—]\s*|\s+to\s+', chr(1), 'i')}, chr(1)) AS sides FROM pay2), pay4 AS (
  SELECT *, {_value('sides[1]')} AS v1, {_unit('sides[1]')} AS u1, {_code('sides[1]')} AS c1,
    {_value('sides[2]')} AS v2, {_unit('sides[2]')} AS u2, {_code('sides[2]')} AS c2 FROM pay3), pay5 AS (
  SELECT *, CASE WHEN u1 IS NOT NULL THEN v1 ELSE v1 * coalesce(u2, 1) END AS plo,
    CASE WHEN u2 IS NOT NULL THEN v2 ELSE v2 * coalesce(u1, 1) END AS phi,
    coalesce(praw = '', true) AS pblank, NOT pbad AND {word('pcanon', 'undisclosed')} AS phidden FROM pay4), pay6 AS (
  SELECT *, coalesce(NOT pblank AND NOT pbad AND NOT phidden AND v1 IS NOT NULL AND (NOT ranged OR v2 IS NOT NULL)
    AND plo <= 1000000000 AND (phi IS NULL OR (phi <= 1000000000 AND plo <= phi)), false) AS pread FROM pay5), pay AS (
  SELECT *, CASE WHEN pread THEN coalesce(c1, c2, CASE WHEN {IN_BOARD} OR {has('praw', r'\b\d{1,3}(?:,\d{2})+,\d{3}\b')}
      OR {word('pcanon', 'lakh|lac|crore|lpa|ctc|inr')} OR {has('praw', r'\b(?:p\.?a\.?|per\s*annum)\b')} OR contains(praw, '₹')
      OR {word('praw', 'lpa|ctc')} THEN 'INR' END) END AS currency,
    CASE WHEN pread THEN plo END AS pay_min, CASE WHEN pread THEN coalesce(phi, plo) END AS pay_max,
    CASE WHEN NOT pread THEN 'unknown' WHEN {has('pcanon', r'\bper\s*year\b')} THEN 'year' WHEN {has('pcanon', r'\bper\s*month\b')} THEN 'month'
      WHEN {has('pcanon', r'\bper\s*hour\b')} THEN 'hour'
      WHEN {word('pcanon', 'lakhs?|lacs?|crores?|cr|lpa|ctc')} OR {word('praw', 'lpa|ctc|l')} THEN 'year' ELSE 'unknown' END AS period,
    NOT pblank AND NOT coalesce(phidden, false) AND NOT pread AS punread FROM pay6)"""

_CITY = trim(swap(swap(swap(trim("string_split(ltext, ',')[1]"), r"\s*\([^)]*\)", "", "g"),
    r"\s*[-/|–—]\s*(?:hybrid|remote|onsite|on-site|wfh|work from home|work from office|full[ -]?time|part[ -]?time)\b.*", "", "i"),
    r"\s+(?:hybrid|remote|onsite|on-site|wfh)\b.*", "", "i"))


def place(names: str) -> str:
    return f"regexp_matches(lower(ltext), '(^|[^a-z])(?:{names})($|[^a-z])')"


def _at(y: str, mo: str, d: str) -> str:
    return f"TRY_CAST(TRY_CAST({y} || '-' || lpad({mo}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) AS TIMESTAMP)"


POSTED = f"""CASE WHEN regexp_full_match(ptext, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(TRY_CAST(ptext AS DATE) AS TIMESTAMP)
  WHEN regexp_full_match(ptext, '\\d{{4}}-\\d{{2}}-\\d{{2}}T.*') THEN TRY_CAST(TRY_CAST(ptext AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)
  WHEN regexp_full_match(ptext, '\\d{{1,2}}\\s+[A-Za-z]{{3}}\\s+\\d{{4}}') THEN
    {_at("regexp_extract(ptext, '(" + chr(92) + "d{4})$', 1)", "CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract(ptext, '[A-Za-z]+'))) AS VARCHAR)", "regexp_extract(ptext, '^" + chr(92) + "d+')")}
  WHEN {IN_BOARD} AND regexp_full_match(ptext, '\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN
    {_at("substr(ptext, 7, 4)", "substr(ptext, 4, 2)", "substr(ptext, 1, 2)")} END"""
# Instants with a zone are spelled out: the session zone of a checker must not matter.
POSTED = POSTED.replace(
    "TRY_CAST(TRY_CAST(ptext AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS TIMESTAMP)",
    "CAST(replace(left(ptext, 19), 'T', ' ') AS TIMESTAMP) + to_milliseconds(coalesce(TRY_CAST(rpad(left(regexp_extract(ptext, '[.](\\d+)', 1), 3), 3, '0') AS INTEGER), 0)) "
    "- CASE WHEN regexp_matches(ptext, '[+]\\d') THEN to_minutes(CAST(substr(right(ptext, 5), 1, 2) AS INTEGER) * 60 + CAST(right(ptext, 2) AS INTEGER)) ELSE to_minutes(0) END",
)

FINGERPRINT = f"'sha256:' || sha256({trim('lower(title)')} || '|' || {trim('lower(coalesce(company, chr(32)))')} || '|' || {trim('lower(coalesce(location, chr(32)))')} || '|' || regexp_replace({trim('lower(description)')}, '\\s+', ' ', 'g'))"

TYPED_SQL = f"""{PARSE_SQL}, place0 AS (SELECT *, {trim('location')} AS ltext, {trim('posted_at_text')} AS ptext FROM pay), place1 AS (
  SELECT *, {_CITY} AS city0 FROM place0), typed AS (
  SELECT *, nullif(ltext, '') AS location_raw,
    CASE WHEN ltext <> '' AND NOT {has('city0', r'^(?:remote|hybrid|onsite|on-site|wfh|anywhere|unspecified)$')} THEN nullif(left(city0, 100), '') END AS city,
    CASE WHEN ltext <> '' THEN {case([(place(n), lit(c)) for n, c in p.COUNTRIES] + [(place('|'.join(p.INDIAN_CITIES)), "'IN'")])} END AS country,
    {MODE} AS remote_mode, {KIND} AS employment_type, {POSTED} AS posted_at, {FINGERPRINT} AS fingerprint,
    CASE WHEN ebad AND coalesce(experience_text, '') = '' THEN NULL ELSE min_years END AS exp_min,
    CASE WHEN ebad AND coalesce(experience_text, '') = '' THEN NULL ELSE max_years END AS exp_max,
    {hits([('experience', "ebad AND coalesce(experience_text, '') <> ''"), ('compensation', "punread AND coalesce(compensation_text, '') <> ''"), ('posted_at', f"coalesce(ptext, '') <> '' AND ({POSTED}) IS NULL")])} AS unparsed
  FROM place1)"""

# ---------------------------------------------------------------- skills and items


def _double(text: str) -> str:
    """Every separator twice, so that neighbouring matches never need the same one."""
    return "".join(c if c.isalnum() or c in "+#" else c * 2 for c in text)


def _re(text: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in text)


_ALIASES = sorted((a for a, _ in TAX.aliases), key=len, reverse=True)
_SKILL_RE = r"(?:^|[^\p{L}\p{N}+#.])(" + "|".join(_re(_double(a)) for a in _ALIASES) + r")(?:$|[^\p{L}\p{N}+#.]|\.\.(?:$|[^\p{L}\p{N}]))"
_NAME_MAP = "MAP {" + ", ".join(f"{lit(_double(a.lower()))}: {lit(n)}" for a, n in TAX.aliases) + "}"
_CAT_MAP = "MAP {" + ", ".join(f"{lit(n)}: {lit(c)}" for n, c in TAX.categories) + "}"


def ordered_distinct(values: str) -> str:
    return f"list_transform(list_filter(list_zip({values}, range(1, len({values}) + 1)), lambda z: list_position({values}, z[1]) = z[2]), lambda z: z[1])"


def skills_sql(source: str, text: str, keep: str = "*", out: str = "skilled") -> str:
    """CTE chain adding ``skills`` to ``source``."""
    bound = ", ".join(lit(n) for n in CASE_BOUND_NAMES)
    return f"""sk0 AS (SELECT {keep}, regexp_extract_all(regexp_replace({text}, '([^\\p{{L}}\\p{{N}}+#])', '\\1\\1', 'g'), {lit(_SKILL_RE)}, 1, 'i') AS found FROM {source}), sk1 AS (
  SELECT *, list_filter(list_transform(found, lambda w: CASE WHEN {_NAME_MAP}[lower(w)] IN ({bound}) AND length(w) = length({_NAME_MAP}[lower(w)])
     AND w <> {_NAME_MAP}[lower(w)] THEN NULL ELSE {_NAME_MAP}[lower(w)] END), lambda n: n IS NOT NULL) AS named FROM sk0), {out} AS (
  SELECT * EXCLUDE (found, named), {ordered_distinct('named')} AS skills FROM sk1)"""


_HEAD = (
    r"(?:requirements|qualifications|must[- ]have|mandatory|desired candidate profile|key skills|nice[- ]to[- ]have|good[- ]to[- ]have|"
    r"preferred|bonus|responsibilities|roles and responsibilities|what you(?:'ll| will) do|job description|"
    r"about (?:the |our )?(?:job|role|team|company|us)|job summary|role summary|overview|summary|benefits|perks|job details)\s*[:\-–—]|"
    r"(?:salary|compensation|pay)\s*(?:[:\-–—]|\d|[₹$])"
)
_LINES = f"flatten(list_transform(string_split(description, chr(10)), lambda l: string_split({swap('l', rf'([.!?;\s])({_HEAD})', chr(92) + '1' + chr(1) + chr(92) + '2')}, chr(1))))"
_BARE = trim(swap(swap(trim("l"), r"^(?:#+\s*|[-*•]|\d+[.)])\s*", "", ""), r"^\*\*|\*\*$", "", "g"))
_SENT = f"""list_transform(string_split({swap(swap('body', r'\b(e\.g|i\.e|etc|vs)\.(\s)', chr(92) + '1' + chr(2) + chr(92) + '2'), r'([.!?])\s+([A-Za-z0-9#*-])', chr(92) + '1' + chr(1) + chr(92) + '2', 'g')}, chr(1)), lambda s: {trim("replace(s, chr(2), '.')")})"""
_TAGS = f"list_transform(string_split(replace(body, ';', ','), ','), lambda s: {trim('s')})"
_LABELS = [(has("line", r"^key skills\s*:?\s*(.*)$"), "'tags'"), (has("line", r"^job details\s*:?\s*(.*)$"), "'details'")] + [
    (has("line", pattern), lit(name)) for name, pattern in sec.HEADINGS
]
_BODY = [("label = 'tags'", grab("line", r"^key skills\s*:?\s*(.*)$", 1)), ("label = 'details'", grab("line", r"^job details\s*:?\s*(.*)$", 1))] + [
    (f"label = {lit(name)}", grab("line", pattern, 1) + (f" || {grab('line', pattern, 2)}" if name == "metadata" else ""))
    for name, pattern in sec.HEADINGS
]

ITEMS_SQL = f"""ln0 AS (SELECT job_id, list_filter(list_transform({_LINES}, lambda l: {_BARE}), lambda l: l <> '') AS lines FROM raw), ln1 AS (
  SELECT job_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM ln0), ln2 AS (
  SELECT *, {case(_LABELS)} AS label FROM ln1), ln3 AS (
  SELECT *, {case(_BODY, 'line')} AS body, coalesce(last_value(label IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY i ROWS UNBOUNDED PRECEDING), 'general') AS s FROM ln2), ln4 AS (
  SELECT job_id, i, CASE s WHEN 'tags' THEN 'must' WHEN 'details' THEN 'metadata' ELSE s END AS section,
    list_filter(CASE WHEN label = 'tags' THEN {_TAGS} ELSE {_SENT} END, lambda s: s <> '') AS sents FROM ln3), ln5 AS (
  SELECT job_id, i, section, unnest(range(1, len(sents) + 1)) AS j, unnest(sents) AS text FROM ln4), item0 AS (
  SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY i, j) - 1 AS pos, section, text, text AS short FROM ln5), {skills_sql('item0', 'short', '*', 'item1')}, item2 AS (
  SELECT *, {hits([(n, has('short', r)) for n, r, _ in DISCRIMINATION])} AS categories,
    {case([(has('short', r), lit(n)) for n, r, _ in CONSTRAINTS])} AS kind FROM item1), item AS (
  SELECT *, CASE WHEN len(categories) > 0 THEN 'flagged' WHEN kind IS NOT NULL AND len(skills) = 0 THEN 'constraint'
    WHEN section = 'metadata' THEN 'metadata'
    WHEN len(skills) = 0 AND ({' OR '.join(has('text', r.replace(chr(92) + 'z', '$')) for r, _ in sec.PURE_METADATA)}) THEN 'metadata'
    WHEN {word('text', sec.PREFERRED_CUE)} THEN 'preferred' WHEN {word('text', sec.MUST_CUE)} THEN 'must'
    WHEN {has('text', sec.INTRO_CUE)} AND len(skills) = 0 THEN 'responsibility' WHEN section <> 'general' THEN section
    WHEN len(skills) > 0 THEN 'must' ELSE 'responsibility' END AS target FROM item2)"""

# One row per posting with its requirement lists.
REQ_SQL = f"""{ITEMS_SQL}, grp AS (SELECT job_id,
    coalesce(list({{'text': short, 'skills': skills}} ORDER BY pos) FILTER (target = 'must'), []) AS must_have,
    coalesce(list({{'text': short, 'skills': skills}} ORDER BY pos) FILTER (target = 'preferred'), []) AS pref,
    coalesce(list(text ORDER BY pos) FILTER (target = 'responsibility'), []) AS duties,
    coalesce(list({{'kind': kind, 'text': short}} ORDER BY pos) FILTER (len(categories) = 0 AND kind IS NOT NULL), []) AS constraints,
    flatten(list(list_transform(categories, lambda c: {{'text': short, 'category': c}}) ORDER BY pos)) AS flags
  FROM item GROUP BY job_id), req0 AS (
  SELECT raw.job_id, coalesce(must_have, []) AS must_have, coalesce(pref, []) AS pref, coalesce(duties, []) AS duties,
    coalesce(constraints, []) AS constraints, coalesce(flags, []) AS flags,
    flatten(list_transform(must_have, lambda r: r.skills)) AS ms, flatten(list_transform(pref, lambda r: r.skills)) AS ps FROM raw LEFT JOIN grp USING (job_id)), req1 AS (
  SELECT *, {ordered_distinct('ms')} AS required, {ordered_distinct('ps')} AS wished FROM req0), req AS (
  SELECT *, list_filter(wished, lambda w: NOT list_contains(required, w)) AS preferred FROM req1)"""

ORACLE: dict[str, str] = {}


def add(name: str, ctes: list[str], select: str) -> None:
    ORACLE[name] = ("WITH RECURSIVE " + ", ".join(ctes) + " " if ctes else "") + select


# ---------------------------------------------------------------- sources

RAW = [t.RAW_SQL]
add("read_postings", RAW, """SELECT fmt, job_id, provider, title, md5(description) AS body, company, location, compensation_text, posted_at_text,
  coalesce(origin, 'user_paste') AS origin, relay_source FROM raw, (VALUES ('json'), ('csv'), ('parquet')) AS f(fmt)""")
_SIZES = [t.profile_sql("customer", "c_custkey"), t.FIELD_SQL, t.PREF_SQL]


def _size(condition: str, source: str = "field") -> str:
    return f"(SELECT count(*) FROM {source} f WHERE f.tpl = prof.tpl AND {condition})"


add("read_profiles", _SIZES, f"""SELECT profile_id, label, years, {_size("kind = 'skill'")} AS skills, {_size("section = 2 AND j = 0")} AS roles,
  {_size("section = 3")} AS certifications, {_size("kind = 'deal_breakers'", "pref")} AS deal_breakers,
  (SELECT text FROM field f WHERE f.tpl = prof.tpl AND section = 5) AS summary_text FROM prof""")
_ALIAS_SQL = t._values("alias", "alias, name", [(a, n) for a, n in TAX.aliases])
_CAT_SQL = t._values("cat", "name, category", list(TAX.categories))
add("load_taxonomy", [t.RAW_SQL, REQ_SQL, _ALIAS_SQL, _CAT_SQL], """, demand AS (SELECT unnest(required) AS name, job_id FROM req)
  SELECT alias, alias.name, category, (SELECT count(*) FROM demand d WHERE d.name = alias.name) AS postings FROM alias JOIN cat ON cat.name = alias.name""")
add("upsert_postings", RAW, f"""SELECT job_id, CASE WHEN l.doc_id IS NULL THEN title ELSE 'Rated ' || quality END AS title,
  CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS batch_seq FROM raw LEFT JOIN labels l USING (doc_id)
  UNION ALL SELECT {t.sql_id('job', 'doc_id')}, 'Rated ' || quality, 1 FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
_OLD = t.profile_sql().replace("prof AS", "old AS", 1)
_NEW = t.profile_sql("customer", "c_custkey").replace("prof AS", "new AS", 1)
add("upsert_profiles", [_OLD, _NEW], f"""SELECT coalesce(new.profile_id, old.profile_id) AS profile_id, coalesce(new.label || ' v2', old.label) AS label,
  {stamp("coalesce(old.updated_at, TIMESTAMP '" + q.NOW + "')")} AS created,
  {stamp("CASE WHEN new.profile_id IS NULL THEN old.updated_at ELSE TIMESTAMP '" + q.NOW + "' END")} AS updated
  FROM old FULL OUTER JOIN new ON old.profile_id = new.profile_id""")
add("export_all", [t.RAW_SQL, t.profile_sql()], """SELECT 'job' AS kind, job_id AS id, title AS name FROM raw
  UNION ALL SELECT 'profile', profile_id, label FROM prof""")

# ---------------------------------------------------------------- ingest quality

VERDICT = f"""CASE WHEN length(title) > 200 OR length(description) > 50000 OR length(coalesce(location, '')) > 200 OR length(source_url) > 2048 THEN 'INPUT_TOO_LARGE'
  WHEN title = '<p></p>' OR origin NOT IN ('user_paste', 'agent_relay') THEN 'INVALID_INPUT' WHEN NOT starts_with(source_url, 'https://') THEN 'UNSAFE_URL' ELSE 'OK' END"""
add("split_valid", [t.PAGE_SQL], f"SELECT job_id, {VERDICT} AS verdict FROM raw")
_DIRTY = f"replace(text, 'e', 'e' || {pick(q.ODD_CHARACTERS, f'doc_id % {len(q.ODD_CHARACTERS)}')})"
_STRIPPED = swap(_DIRTY, FORBIDDEN, "", "g")
add("strip_forbidden_unicode", [], f"SELECT doc_id, length({_DIRTY}) AS before, length({_STRIPPED}) AS after, md5({_STRIPPED}) AS body FROM documents")
add("html_to_text", [f"x AS (SELECT page_id, {html_sql('html')} AS t FROM pages)"], "SELECT page_id, length(t) AS chars, md5(t) AS body FROM x")
_MARKED = f"replace(html, ' ', {pick(q.ENTITY_MARKS, f'page_id % {len(q.ENTITY_MARKS)}')} || ' ')"
add("decode_entities", [f"x AS (SELECT page_id, {entity_sql(_MARKED)} AS t FROM pages)"], "SELECT page_id, length(t) AS chars, md5(t) AS body FROM x")
add("sanitize_text", ["src AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)",
    clean_sql("src", "body", "kind, id, body")], """SELECT kind, id, length(clean) AS chars, md5(clean) AS digest,
  CASE WHEN clean <> body THEN 'Content in ''body'' was sanitized' ELSE '' END AS warnings FROM tidy""")
_SCAN = f"""scan AS (SELECT 'd' || doc_id AS job_id, {pick(t.BOARDS, 'doc_id % 2')} AS provider,
    {pick(q.INJECTED, f'doc_id % {len(q.INJECTED)}')} || chr(10) || text AS body FROM documents
  UNION ALL SELECT 'c' || conv_id || '-' || turn, 'board_global', text FROM conversations), found AS (
  SELECT job_id, provider, {hits([(n, has('body', r, f.replace('m', '')) if 'm' not in f else has('body', '(?m)' + r, 'i')) for n, r, f, _ in SIGNALS])} AS signals FROM scan)"""
add("detect_injection", [_SCAN], f"SELECT job_id, {joined('signals')} AS signals, len(signals) > 0 AS suspected FROM found")
add("injection_report", [_SCAN], """, one AS (SELECT provider, job_id, unnest(signals) AS signal FROM found)
  SELECT provider, signal, count(*) AS hits, count(DISTINCT job_id) AS postings FROM one GROUP BY 1, 2""")
_ADDRESS = f"CASE WHEN {pick(q.URL_FORMS, f'page_id % {len(q.URL_FORMS)}')} = '' THEN url ELSE {pick(q.URL_FORMS, f'page_id % {len(q.URL_FORMS)}')} END"
_REASON = case([
    ("contains(a, chr(92))", "'URL must not contain backslashes'"), ("contains(a, ' ')", "'URL must not contain whitespace'"),
    ("NOT contains(a, ':')", "'Malformed URL'"), ("NOT starts_with(a, 'https://')", "'Only HTTPS protocol is allowed'"),
    ("contains(host, '@')", "'Userinfo (credentials in URL) is not allowed'"), ("regexp_matches(host, ':[0-9]+$') AND NOT ends_with(host, ':443')", "'Explicit port must be 443'"),
    ("regexp_full_match(host, '[0-9.]+')", "'IP address literals are not allowed'"),
    ("host = 'localhost' OR ends_with(host, '.internal')", "'Local and internal hosts are not allowed'"),
])
add("validate_urls", [f"a0 AS (SELECT page_id, {_ADDRESS} AS a FROM pages)", "a1 AS (SELECT *, lower(regexp_extract(a, '^https?://([^/?#]*)', 1)) AS host FROM a0)",
    f"a2 AS (SELECT *, {_REASON} AS reason, replace(host, ':443', '') AS h FROM a1)"], f"""SELECT page_id, reason IS NULL AS ok,
  CASE WHEN reason IS NULL THEN 'https://' || h || regexp_replace(a, '^https://[^/?#]*', '') END AS url,
  CASE WHEN reason IS NULL THEN NOT contains(h, 'xn--') AND ({' OR '.join(f"h = {lit(x)} OR ends_with(h, {lit('.' + x)})" for x in q.HOSTS)}) END AS is_official, reason FROM a2""")
add("attach_provenance", RAW, f"""SELECT job_id, CASE WHEN origin = 'agent_relay' THEN 'agent_relay' ELSE 'user_supplied' END AS kind,
  CASE WHEN origin = 'agent_relay' THEN coalesce(relay_source, 'Agent relay') ELSE 'User supplied' END AS detail, {stamp('ingested_at')} AS captured_at FROM raw""")

# ---------------------------------------------------------------- normalization

add("remote_mode", RAW, f"SELECT job_id, {cue('description', p.REMOTE_MODE_CUES)} AS of_description, {MODE} AS remote_mode FROM raw")
add("employment_type", RAW, f"SELECT job_id, {KIND} AS employment_type FROM raw")
add("parse_experience", [t.RAW_SQL, PARSE_SQL], "SELECT job_id, min_years, max_years, md5(eraw) AS raw, ebad AS unparsed FROM exper")
add("canonical_pay_text", RAW, f"SELECT job_id, {pay_words('compensation_text')} AS pay, md5({pay_words('description')}) AS body FROM raw")
add("pay_fragment", RAW, f"SELECT job_id, {FRAGMENT} AS fragment FROM raw")
add("parse_compensation", [t.RAW_SQL, PARSE_SQL], """SELECT job_id, CASE WHEN NOT pblank THEN left(praw, 200) END AS raw, currency, pay_min AS min, pay_max AS max, period,
  pread AS disclosed, punread AS unparsed FROM pay""")
add("parse_location", [t.RAW_SQL, TYPED_SQL], "SELECT job_id, location_raw AS raw, city, country FROM typed")
add("parse_posted_at", [t.RAW_SQL, TYPED_SQL], f"SELECT job_id, {stamp('posted_at')} AS posted_at FROM typed")
add("fingerprint", RAW, f"SELECT job_id, {FINGERPRINT} AS fingerprint FROM raw")
add("normalize_postings", [t.RAW_SQL, TYPED_SQL], f"""SELECT job_id, remote_mode, employment_type, exp_min AS min_years, exp_max AS max_years, currency, pay_max,
  city, country, {stamp('posted_at')} AS posted_at, fingerprint, {joined('unparsed')} AS unparsed FROM typed""")

# ---------------------------------------------------------------- extraction

ITEMS = [t.RAW_SQL, ITEMS_SQL]
REQ = [t.RAW_SQL, REQ_SQL]
add("section_items", ITEMS, "SELECT job_id, pos, section, md5(text) AS body FROM item")
add("match_skills", [t.RAW_SQL, skills_sql("raw", "(title || chr(10) || description)")], f"SELECT job_id, {joined('skills')} AS skills FROM skilled")
add("classify_items", ITEMS, "SELECT job_id, section, target, count(*) AS items, CAST(sum(pos) AS BIGINT) AS places FROM item GROUP BY 1, 2, 3")
add("flag_discrimination", ITEMS, "SELECT job_id, pos, unnest(categories) AS category, short AS text FROM item")
add("classify_constraints", REQ, "SELECT job_id, unnest(range(0, len(constraints))) AS n, unnest(constraints).kind AS kind, unnest(constraints).text AS text FROM req")


def listed(column: str) -> str:
    return joined(f"list_transform({column}, lambda r: r.text || '=' || coalesce(array_to_string(r.skills, ','), ''))")


add("extract_requirements", REQ, f"""SELECT job_id, {listed('must_have')} AS must_have, {listed('pref')} AS preferred, len(duties) AS duties,
  md5({joined('duties')}) AS duty_text, len(constraints) AS constraints, len(flags) AS flags FROM req""")
add("posting_skills", REQ, f"SELECT job_id, {joined('required')} AS required, {joined('preferred')} AS preferred, len(must_have) AS qualifications FROM req")
add("discrimination_warnings", REQ, """SELECT job_id, unnest(range(0, len(flags))) AS n,
  'Potentially discriminatory ' || unnest(flags).category || ' requirement' AS message FROM req""")
add("discrimination_report", REQ, """, one AS (SELECT job_id, unnest(flags).category AS category FROM req)
  SELECT category, count(*) AS flags, count(DISTINCT job_id) AS postings FROM one GROUP BY 1""")
add("skill_demand", REQ, f""", one AS (SELECT unnest(required) AS skill, 1 AS r, 0 AS w FROM req UNION ALL SELECT unnest(preferred), 0, 1 FROM req)
  SELECT skill, CAST(sum(r) AS BIGINT) AS required_in, CAST(sum(w) AS BIGINT) AS preferred_in, {_CAT_MAP}[skill] AS category FROM one GROUP BY 1""")

# ---------------------------------------------------------------- duplicates

COMPANY = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(company, '')), '[^a-z0-9_\\s]', ' ', 'g'), '\\b(?:private\\s+limited|pvt\\s+ltd|pvt|private|limited|ltd|incorporated|inc|llc|corporation|corp)\\b', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def tokens(text: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({text}), '[a-z0-9]+')))"


def shingle_sql(words: str) -> str:
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len({words}) - 4, 1) + 1), lambda i: array_to_string({words}[i:i + 4], ' ')))) END"


add("normalize_company", RAW, f"SELECT job_id, {COMPANY} AS company FROM raw")
add("title_tokens", RAW, f"SELECT job_id, {joined(tokens('title'))} AS tokens FROM raw")
add("shingles", ["w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)", f"s AS (SELECT doc_id, {shingle_sql('w')} AS s FROM w)"],
    f"SELECT doc_id, len(s) AS shingles, md5({joined('s')}) AS digest FROM s")
add("jaccard", [f"s AS (SELECT doc_id, {tokens('text')} AS a FROM documents)"], """SELECT x.doc_id, round(CASE WHEN len(x.a) + len(y.a) = 0 THEN 1.0
  ELSE len(list_intersect(x.a, y.a))::DOUBLE / (len(x.a) + len(y.a) - len(list_intersect(x.a, y.a))) END, 6) AS similarity FROM s x JOIN s y ON y.doc_id + 1 = x.doc_id""")
COPIES = [t.COPY_SQL.replace("AS description,", "AS description, NULL AS location,", 1), f"""cp0 AS (SELECT *, {FINGERPRINT} AS fp, {COMPANY} AS co, {tokens('title')} AS tt,
  regexp_extract_all(lower(description), '[a-z0-9]+') AS w FROM raw), cp AS (SELECT job_id, ingested_at, fp, co, tt, {shingle_sql('w')} AS sh FROM cp0)"""]
CLASSES = COPIES + ["""cls AS (SELECT co, tt, sh, min(job_id) AS rep, count(*) AS n, min(fp) AS lofp, max(fp) AS hifp FROM cp GROUP BY 1, 2, 3), mem AS (
  SELECT cp.job_id, cp.fp, rep, cp.co FROM cp JOIN cls ON cls.co = cp.co AND cls.tt = cp.tt AND cls.sh = cp.sh), one AS (
  SELECT rep, co, unnest(sh) AS s FROM cls), met AS (
  SELECT x.rep AS a, y.rep AS b, count(*) AS shared FROM one x JOIN one y ON x.co = y.co AND x.s = y.s AND x.rep < y.rep GROUP BY 1, 2), sim AS (
  SELECT a, b, x.co, len(list_intersect(x.tt, y.tt))::DOUBLE / (len(x.tt) + len(y.tt) - len(list_intersect(x.tt, y.tt))) AS ts,
    shared::DOUBLE / (len(x.sh) + len(y.sh) - shared) AS ds FROM met JOIN cls x ON x.rep = a JOIN cls y ON y.rep = b), near AS (
  SELECT * FROM sim WHERE ts >= 0.8 AND ds >= 0.85), pairsim AS (
  SELECT a AS job_id_a, b AS job_id_b, co AS company, ts, ds FROM near
  UNION ALL SELECT rep, job_id, mem.co, 1.0, 1.0 FROM mem JOIN cls USING (rep) WHERE job_id > rep AND lofp <> hifp), ev AS (
  SELECT *, 'Heuristic match: company ''' || company || ''', title similarity ' || format('{:.2f}', ts) || ', description similarity ' || format('{:.2f}', ds) AS evidence FROM pairsim)"""]
add("exact_duplicates", COPIES, """, g AS (SELECT fp, min(job_id) AS first_job_id, count(*) AS copies FROM cp GROUP BY 1 HAVING count(*) > 1)
  SELECT fp AS fingerprint, first_job_id, copies, job_id FROM cp JOIN g USING (fp)""")
add("near_duplicate_pairs", CLASSES, "SELECT job_id_a, job_id_b, company, round(ts, 6) AS title_similarity, round(ds, 6) AS description_similarity FROM pairsim")
GROUPS = CLASSES + ["""edge AS (SELECT a, b FROM near UNION SELECT b, a FROM near), reach AS (
  SELECT rep AS a, rep AS b FROM cls UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b), lab AS (
  SELECT a AS rep, min(b) AS label FROM reach GROUP BY 1), gm AS (SELECT job_id, fp, label FROM mem JOIN lab USING (rep)), gs AS (
  SELECT label, min(job_id) AS group_id, count(*) AS group_size FROM gm GROUP BY 1 HAVING count(*) > 1)"""]
add("duplicate_groups", GROUPS, "SELECT group_id, job_id, group_size FROM gm JOIN gs USING (label)")
add("group_evidence", GROUPS, """, reason AS (SELECT min(job_id) AS job_id, 'Identical fingerprint: ' || fp AS evidence FROM cp GROUP BY fp HAVING count(*) > 1
  UNION ALL SELECT job_id_a, evidence FROM ev) SELECT DISTINCT group_id, evidence FROM reason JOIN gm USING (job_id) JOIN gs USING (label)""")
# Ids rise with the time of arrival. Who was seen before: a fingerprint, else a class, else similar classes.
SEEN = """pf1 AS (SELECT fp, min(job_id) AS first FROM cp GROUP BY 1), dup AS (
  SELECT job_id, first AS existing_job_id, 'Identical fingerprint: ' || fp AS reason FROM cp JOIN pf1 USING (fp) WHERE job_id <> first
  UNION ALL SELECT mem.job_id, rep, 'Heuristic match: company ''' || co || ''', title similarity 1.00, description similarity 1.00'
    FROM mem JOIN pf1 USING (fp) WHERE mem.job_id <> rep AND mem.job_id = first AND co <> ''
  UNION ALL SELECT b, a, 'Heuristic match: company ''' || co || ''', title similarity ' || format('{:.2f}', ts) || ', description similarity ' || format('{:.2f}', ds) FROM near WHERE co <> '')"""
# All against all, the posting itself included: every match is named.
BATCH = COPIES + ["""old AS (SELECT * FROM cp), w1 AS (SELECT job_id, co, unnest(sh) AS s FROM cp), w2 AS (
  SELECT job_id, co, unnest(sh) AS s FROM old), m0 AS (SELECT w1.job_id AS a, w2.job_id AS b, count(*) AS shared FROM w1 JOIN w2 USING (co, s) GROUP BY 1, 2), m1 AS (
  SELECT a, b, x.co, len(list_intersect(x.tt, y.tt))::DOUBLE / (len(x.tt) + len(y.tt) - len(list_intersect(x.tt, y.tt))) AS ts,
    shared::DOUBLE / (len(x.sh) + len(y.sh) - shared) AS ds FROM m0 JOIN cp x ON x.job_id = a JOIN old y ON y.job_id = b WHERE x.fp <> y.fp), dup AS (
  SELECT a AS job_id, b AS existing_job_id, 'Heuristic match: company ''' || co || ''', title similarity ' || format('{:.2f}', ts) || ', description similarity ' || format('{:.2f}', ds) AS reason
    FROM m1 WHERE ts >= 0.8 AND ds >= 0.85
  UNION ALL SELECT cp.job_id, old.job_id, 'Identical fingerprint: ' || cp.fp FROM cp JOIN old ON cp.fp = old.fp)"""]
add("check_batch_duplicates", BATCH, "SELECT job_id, existing_job_id, reason FROM dup")
add("duplicate_warnings", BATCH, """SELECT dup.job_id, 'Job appears to be a duplicate of existing job(s): ' || string_agg(existing_job_id, ', ' ORDER BY old.ingested_at DESC, existing_job_id DESC) AS message
  FROM dup JOIN old ON old.job_id = existing_job_id GROUP BY 1""")

_CODES = f"""list_concat(CASE WHEN clean <> raw0.description THEN ['CONTENT_SANITIZED:description'] ELSE [] END,
  CASE WHEN raw0.doc_id % 4 IN (1, 2) THEN ['URL_NOT_OFFICIAL:'] ELSE [] END,
  list_transform(typed.unparsed, lambda f: 'FIELD_UNPARSED:' || f),
  list_transform(req.flags, lambda f: 'POTENTIALLY_DISCRIMINATORY_REQUIREMENT:'),
  CASE WHEN raw0.job_id IN (SELECT job_id FROM dup) THEN ['DUPLICATE_SUSPECTED:'] ELSE [] END, ['UNTRUSTED_CONTENT:'])"""
add("attach_warnings", [t.RAW_SQL.replace("raw AS", "raw0 AS", 1), clean_sql("raw0", "description", "doc_id, job_id").replace("s0 AS", "z0 AS", 1).replace("FROM s0)", "FROM z0)"),
    "raw AS (SELECT raw0.* REPLACE (clean AS description) FROM raw0 JOIN tidy USING (doc_id) WHERE length(raw0.description) <= 50000)",
    TYPED_SQL, REQ_SQL, *CLASSES[1:], SEEN, f"coded AS (SELECT raw0.job_id, {_CODES} AS codes FROM raw0 JOIN tidy USING (doc_id) JOIN typed ON typed.doc_id = raw0.doc_id JOIN req ON req.job_id = raw0.job_id)"],
    "SELECT job_id, len(codes) AS flag_count, array_to_string(codes, '|') AS codes FROM coded")

# ---------------------------------------------------------------- matching

_PATTERN = "'(^|[^A-Za-z0-9_])' || regexp_escape(skill) || CASE WHEN regexp_matches(skill, '[A-Za-z0-9_]$') THEN '($|[^A-Za-z0-9_])' ELSE '($|[^A-Za-z_+#])' END"
_SYN = "MAP {" + ", ".join(f"{lit(a)}: {lit(b)}" for a, b in m.CITY_SYNONYMS.items()) + "}"


def city_sql(text: str) -> str:
    plain = trim(f"regexp_replace({swap(swap(f'lower({trim(f'coalesce({text}, chr(32))')})', r'\s*\([^)]*\)', '', 'g'), r'\s*[-/|–—].*', '', '')}, '[.,]', '', 'g')")
    return f"coalesce({_SYN}[{plain}], {plain})"


def prefs(kind: str, of: str = "value") -> str:
    return f"coalesce((SELECT list({of} ORDER BY pos) FROM pref WHERE pref.tpl = prof.tpl AND kind = {lit(kind)}), [])"


FEATURES = [t.RAW_SQL, TYPED_SQL, REQ_SQL, t.profile_sql(), t.FIELD_SQL, t.PREF_SQL, t.PAIR_SQL, f"""jobf AS (SELECT job_id, title, description,
    {ordered_distinct('ms')} AS must, {ordered_distinct('ps')} AS asked, required, preferred, must_have, pref AS wishes, duties, constraints,
    list_concat(ms, ps, required, preferred) AS every, exp_min, exp_max, remote_mode, employment_type, city, {city_sql('city')} AS city_key,
    {case([(word('title', r), str(n)) for n, r in m.TITLE_LEVELS])} AS tlevel FROM req JOIN typed USING (job_id)), want AS (
  SELECT DISTINCT unnest(list_concat(must, asked, every)) AS skill FROM jobf), thas AS (
  SELECT DISTINCT tpl, skill FROM field JOIN want ON (kind = 'skill' AND lower(trim(text)) = lower(skill)) OR (kind = 'role' AND regexp_matches(text, {_PATTERN}, 'i'))), proff AS (
  SELECT pkey, profile_id, tpl, years, coalesce((SELECT list(skill) FROM thas WHERE thas.tpl = prof.tpl), []) AS has,
    {prefs('locations')} AS locations, {prefs('locations', city_sql('value'))} AS location_keys, {prefs('remote_modes')} AS remote_modes,
    {prefs('employment_types')} AS employment_types,
    CASE WHEN years < 1 THEN 0 WHEN years < 3 THEN 1 WHEN years < 6 THEN 2 WHEN years < 10 THEN 3 WHEN years < 15 THEN 4 ELSE 5 END AS plevel,
    CASE WHEN years = floor(years) THEN CAST(CAST(years AS BIGINT) AS VARCHAR) ELSE CAST(years AS VARCHAR) END AS ytext FROM prof)"""]

_DOMAIN = f"list_filter({ordered_distinct('every')}, lambda s: {_CAT_MAP}[s] IS NOT NULL)"


def _cover(skills: str) -> tuple[str, str, str]:
    got = f"list_filter({skills}, lambda s: list_contains(has, s))"
    lost = f"list_filter({skills}, lambda s: NOT list_contains(has, s))"
    return f"CASE WHEN len({skills}) > 0 THEN {half_up(f'len({got})::DOUBLE / len({skills})')} END", got, lost


def _named(values: str) -> str:
    return f"list_transform({values}, lambda s: s || ' (' || {_CAT_MAP}[s] || ')')"


_TOP = "coalesce(CAST(exp_max AS VARCHAR), 'any')"
_MODE_OK = "list_contains(remote_modes, remote_mode)"
_EXP = f"""CASE WHEN exp_min IS NULL AND exp_max IS NULL THEN NULL
  WHEN years < exp_min THEN {half_up('greatest(0.0::DOUBLE, 1 - (exp_min - years) / greatest(exp_min, 1))')}
  WHEN years > exp_max THEN CASE WHEN years - exp_max <= 2 THEN 1.0::DOUBLE ELSE {half_up('greatest(0.5::DOUBLE, 1 - (years - exp_max - 2) * 0.1::DOUBLE)')} END ELSE 1.0::DOUBLE END"""
_SEN = f"CASE WHEN tlevel IS NOT NULL THEN {half_up('greatest(0.0::DOUBLE, 1 - 0.34::DOUBLE * abs(plevel - tlevel))')} END"
_LOC = f"""CASE WHEN (len(locations) = 0 AND len(remote_modes) = 0) OR (coalesce(trim(city), '') = '' AND remote_mode = 'unknown') THEN NULL
  WHEN remote_mode = 'remote' AND {_MODE_OK} THEN 1.0::DOUBLE WHEN city_key <> '' AND list_contains(location_keys, city_key) THEN 1.0::DOUBLE
  WHEN remote_mode <> 'unknown' AND {_MODE_OK} THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"""
_EMP = "CASE WHEN employment_type = 'unknown' OR len(employment_types) = 0 THEN NULL WHEN list_contains(employment_types, employment_type) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_PLACE = "'Job remote mode ''' || remote_mode || ''' and location ''' || coalesce(city, 'unspecified') || ''' '"
_M, _P, _D = _cover("must"), _cover("asked"), _cover("dom")
DIMS = {
    "must_have_skills": ("dim_must_have", *_M),
    "experience": ("dim_experience", _EXP,
        f"CASE WHEN sc > 0 THEN ['Profile experience (' || ytext || 'y) vs JD requirements (' || coalesce(CAST(exp_min AS VARCHAR), '0') || '-' || {_TOP} || 'y)'] ELSE [] END",
        f"CASE WHEN sc >= 1 THEN [] WHEN years < exp_min THEN ['Profile experience (' || ytext || 'y) is below minimum requirement (' || exp_min || 'y)'] ELSE ['Profile experience (' || ytext || 'y) exceeds maximum requirement (' || {_TOP} || 'y)'] END"),
    "preferred_skills": ("dim_preferred", *_P),
    "seniority": ("dim_seniority", _SEN, "CASE WHEN sc > 0 THEN ['Title level ' || tlevel || ' corresponds to profile experience level ' || plevel] ELSE [] END",
        "CASE WHEN sc < 1 THEN ['Seniority difference of ' || abs(plevel - tlevel) || ' level(s)'] ELSE [] END"),
    "location_remote": ("dim_location", _LOC, f"CASE WHEN sc > 0 THEN [{_PLACE} || 'match preferences'] ELSE [] END", f"CASE WHEN sc = 0 THEN [{_PLACE} || 'do not match preferences'] ELSE [] END"),
    "employment_type": ("dim_employment", _EMP, "CASE WHEN sc = 1 THEN ['Employment type ''' || employment_type || ''' matches preference'] ELSE [] END",
        "CASE WHEN sc = 0 THEN ['Job employment type ''' || employment_type || ''' not in preferred types'] ELSE [] END"),
    "domain": ("dim_domain", _D[0], _named(_D[1]), _named(_D[2])),
}
_PAIRED = f"pf AS (SELECT pair.job_id, pair.profile_id, jobf.* EXCLUDE (job_id), {_DOMAIN} AS dom, proff.* EXCLUDE (profile_id, pkey) FROM pair JOIN jobf USING (job_id) JOIN proff USING (profile_id))"
for _name, (_key, _score, _good, _bad) in DIMS.items():
    add(_key, FEATURES + [_PAIRED, f"d AS (SELECT *, {_score} AS sc FROM pf)"], f"""SELECT job_id, profile_id, {m.WEIGHTS[_name]}::DOUBLE AS weight, sc AS score,
  CASE WHEN sc IS NULL THEN 'unknown' WHEN sc = 1 THEN 'matched' WHEN sc > 0 THEN 'partial' ELSE 'missing' END AS status,
  CASE WHEN sc IS NULL THEN '' ELSE {joined(_good)} END AS evidence, CASE WHEN sc IS NULL THEN '' ELSE {joined(_bad)} END AS gaps FROM d""")

_ALL = [f"s{i}" for i in range(7)]
_W = [f"{w}::DOUBLE" for w in m.WEIGHTS.values()]
_TEXTS = "list_concat([title, description], list_transform(must_have, lambda r: r.text), list_transform(wishes, lambda r: r.text), duties, list_transform(constraints, lambda c: c.text))"
BLOCK = f"""phr AS (SELECT DISTINCT tpl, pos, trim(value) AS phrase FROM pref WHERE kind = 'deal_breakers' AND trim(value) <> ''), phit AS (
  SELECT job_id, phrase FROM jobf, (SELECT DISTINCT phrase, '(^|[^A-Za-z0-9_])' || regexp_escape(phrase) || '($|[^A-Za-z0-9_])' AS pat FROM phr)
  WHERE len(list_filter({_TEXTS}, lambda x: regexp_matches(x, pat, 'i'))) > 0), blocked AS (
  SELECT pair.job_id, pair.profile_id, list('Deal breaker ''' || phr.phrase || ''' matched in job listing' ORDER BY pos) AS blockers
  FROM pair JOIN proff USING (profile_id) JOIN phr USING (tpl) JOIN phit ON phit.job_id = pair.job_id AND phit.phrase = phr.phrase GROUP BY 1, 2)"""


def scored(pairs: str = "pf") -> str:
    scores = ", ".join(f"{d[1]} AS s{i}" for i, d in enumerate(DIMS.values()))
    conf = " + ".join(f"CASE WHEN {s} IS NULL THEN 0.0::DOUBLE ELSE {w} END" for s, w in zip(_ALL, _W))
    total = " + ".join(f"coalesce({s} * {w}, 0.0::DOUBLE)" for s, w in zip(_ALL, _W))
    count = {st: " + ".join(f"CASE WHEN {cond.format(s=s)} THEN 1 ELSE 0 END" for s in _ALL) for st, cond in (
        ("matched", "{s} = 1"), ("partial", "{s} > 0 AND {s} < 1"), ("missing", "{s} = 0"), ("unknown", "{s} IS NULL"))}
    return f"""sc0 AS (SELECT *, {scores} FROM {pairs}), sc1 AS (SELECT sc0.*, coalesce(blockers, []) AS blockers, {half_up(conf)} AS confidence, {total} AS total
    FROM sc0 LEFT JOIN blocked USING (job_id, profile_id)), sc2 AS (
  SELECT *, CASE WHEN confidence > 0 THEN {half_up('total / confidence')} ELSE 0.0 END AS raw_score FROM sc1), fit AS (
  SELECT *, CASE WHEN len(blockers) > 0 THEN least(raw_score, 0.3::DOUBLE) ELSE raw_score END AS fit_score,
    {', '.join(f'{sql} AS n_{st}' for st, sql in count.items())} FROM sc2)"""


_BAND = "CASE WHEN fit_score >= 0.75 THEN 'strong' WHEN fit_score >= 0.5 THEN 'moderate' ELSE 'weak' END"


def _reason(i: int, name: str) -> str:
    lead = {"must_have_skills": ("Must-have skills matched", _M[1]), "preferred_skills": ("Preferred skills matched", _P[1]), "domain": ("Domain expertise matched", _named(_D[1]))}
    plain = {"experience": "Experience requirement matched", "seniority": "Seniority level aligned", "location_remote": "Location and remote preference aligned", "employment_type": "Employment type matched"}
    text = lit(plain[name]) if name in plain else f"'{lead[name][0]}: ' || array_to_string(({lead[name][1]})[1:3], ', ')"
    return f"CASE WHEN s{i} > 0 THEN {{'r': -(s{i} * {_W[i]}), 'p': {i}, 't': {text}}} END"


_REASONS = f"list_transform(list_sort(list_filter([{', '.join(_reason(i, n) for i, n in enumerate(DIMS))}], lambda x: x IS NOT NULL))[1:3], lambda x: x.t)"
FIT = FEATURES + [_PAIRED, BLOCK, scored()]
add("profile_skill_hits", [t.RAW_SQL, REQ_SQL, t.profile_sql("customer", "c_custkey"), t.FIELD_SQL], f""", want AS (SELECT DISTINCT unnest(list_concat(ms, ps)) AS skill FROM req), thas AS (
  SELECT DISTINCT tpl, skill FROM field JOIN want ON (kind = 'skill' AND lower(trim(text)) = lower(skill)) OR (kind = 'role' AND regexp_matches(text, {_PATTERN}, 'i')))
  SELECT profile_id, skill FROM prof JOIN thas USING (tpl)""")
add("canonical_city", RAW, f"SELECT job_id, {city_sql('location')} AS city FROM raw")
add("deal_breakers", FEATURES + [BLOCK], f"SELECT job_id, profile_id, {joined('blockers')} AS blockers FROM blocked")
add("fit_scores", FIT, f"""SELECT job_id, profile_id, fit_score, {_BAND} AS band, confidence, len(blockers) AS blockers,
  CASE WHEN confidence < 0.6 THEN 'LOW_CONFIDENCE' ELSE '' END AS warning_codes FROM fit""")
add("explain_matches", FIT, f"""SELECT job_id, profile_id, 'Overall fit score: ' || CAST(floor(fit_score * 100 + 0.5) AS INTEGER) || '% (' || {_BAND} || ' match)|Confidence level: '
  || CAST(floor(confidence * 100 + 0.5) AS INTEGER) || '% based on known job dimensions|Dimension summary: ' || n_matched || ' matched, ' || n_partial || ' partial, '
  || n_missing || ' missing, ' || n_unknown || ' unknown' || CASE WHEN len(blockers) > 0 THEN '|Score capped at 0.30 due to ' || len(blockers) || ' deal-breaker blocker(s)' ELSE '' END AS facts FROM fit""")
add("match_reasons", FIT, f"SELECT job_id, profile_id, {joined(_REASONS)} AS reasons FROM fit")
_LATEST = """latest AS (SELECT job_id FROM (SELECT job_id, remote_mode, retention_class FROM typed ORDER BY ingested_at DESC, job_id DESC LIMIT 500)
  WHERE remote_mode IN ('remote', 'hybrid', 'unknown') AND retention_class IN ('standard_180d', 'pinned'))"""
_SHORT = [c for c in FEATURES if c is not t.PAIR_SQL] + [_LATEST, "pair AS (SELECT job_id, profile_id FROM latest, prof)", _PAIRED, BLOCK, scored()]
add("shortlist", _SHORT, f""", top AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY fit_score DESC, job_id) AS rank FROM fit)
  SELECT profile_id, rank, job_id, fit_score, {_BAND} AS band, {joined(_REASONS)} AS reasons FROM top WHERE rank <= 20""")

# ---------------------------------------------------------------- preparation

_SNIP = "CASE WHEN length(text) <= 300 THEN text ELSE substr(text, least(greatest(strpos(lower(text), lower(skill)) - 1 - (300 - length(skill)) // 2, 0), length(text) - 300) + 1, 300) END"
TEV = f"""tev0 AS (SELECT tpl, skill, section, i, j, field_path, CASE WHEN kind = 'skill' THEN text ELSE {_SNIP} END AS snip FROM field
    JOIN want ON (kind = 'skill' AND lower(trim(text)) = lower(skill)) OR (kind <> 'skill' AND regexp_matches(text, {_PATTERN}, 'i'))), tev AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tpl, skill ORDER BY section, i, j) AS rank FROM tev0))"""
ASK = """rq AS (SELECT job_id, 'must_have' AS kind, unnest(range(0, len(must_have))) AS req_pos, unnest(must_have) AS r FROM jobf
  UNION ALL SELECT job_id, 'preferred', unnest(range(0, len(wishes))), unnest(wishes) FROM jobf), rs AS (
  SELECT job_id, kind, req_pos, r.text AS requirement, unnest(range(0, len(r.skills))) AS skill_pos, unnest(r.skills) AS skill FROM rq), ask AS (
  SELECT pair.job_id, pair.profile_id, proff.tpl, rs.* EXCLUDE (job_id) FROM pair JOIN rs USING (job_id) JOIN proff USING (profile_id)), lost AS (
  SELECT * FROM ask WHERE NOT EXISTS (SELECT 1 FROM tev WHERE tev.tpl = ask.tpl AND tev.skill = ask.skill))"""
PREP = FEATURES + [TEV, ASK]
add("skill_evidence", [t.RAW_SQL, REQ_SQL, t.profile_sql("customer", "c_custkey"), t.FIELD_SQL, "want AS (SELECT DISTINCT unnest(list_concat(ms, ps)) AS skill FROM req)", TEV],
    "SELECT profile_id, skill, rank, field_path, snip AS text FROM prof JOIN tev USING (tpl)")
add("verify_evidence", [t.RAW_SQL, REQ_SQL, t.profile_sql("customer", "c_custkey"), t.FIELD_SQL, "want AS (SELECT DISTINCT unnest(list_concat(ms, ps)) AS skill FROM req)", TEV],
    "SELECT profile_id, field_path, skill, snip || ' \u2020' AS text FROM prof JOIN tev USING (tpl) WHERE pkey % 7 = 0")
add("cv_emphasis", PREP, """, f AS (SELECT ask.*, tev.rank, tev.field_path, row_number() OVER (PARTITION BY job_id, profile_id, kind, req_pos, field_path ORDER BY skill_pos, rank) AS n
    FROM ask JOIN tev ON tev.tpl = ask.tpl AND tev.skill = ask.skill), g AS (
  SELECT job_id, profile_id, kind, req_pos, requirement, list(field_path ORDER BY skill_pos, rank) AS paths FROM f WHERE n = 1 GROUP BY ALL), h AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, profile_id ORDER BY kind, req_pos) AS k FROM g)
  SELECT job_id, profile_id, kind, req_pos, requirement, array_to_string(paths, '|') AS paths FROM h""")
add("cv_gaps", PREP, """, g AS (SELECT job_id, profile_id, kind, req_pos, requirement, string_agg(skill, '|' ORDER BY skill_pos) AS missing_skills FROM lost GROUP BY 1, 2, 3, 4, 5), h AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, profile_id ORDER BY kind, req_pos) AS k FROM g) SELECT * EXCLUDE (k) FROM h""")
add("do_not_claim", PREP, """, g AS (SELECT job_id, profile_id, skill, min((kind, req_pos, skill_pos)) AS place FROM lost GROUP BY 1, 2, 3), h AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, profile_id ORDER BY place) AS k FROM g)
  SELECT job_id, profile_id, skill, 'No evidence in profile for ' || skill || '; do not claim it.' AS sentence FROM h""")
add("unassessed", FEATURES, """, u AS (SELECT job_id, list_transform(list_filter(list_concat(must_have, wishes), lambda r: len(r.skills) = 0), lambda r: r.text) AS texts FROM jobf), v AS (
  SELECT job_id, CAST(unnest(range(0, len(texts))) AS INTEGER) AS pos, unnest(texts) AS requirement FROM u) SELECT pair.job_id, profile_id, pos, requirement FROM pair JOIN v USING (job_id)""")


def _fill(lines, limit: int) -> str:
    return "[" + ", ".join(f"left(replace({lit(x)}, '%s', subject), {limit})" for x in lines) + "]"


_PHASES = list(prep.TOPIC_TITLES)
_TOPIC = case([(f"ph = {lit(n)}", f"{_fill([prep.TOPIC_TITLES[n]], 200)}[1]") for n in _PHASES])
_POINT = case([(f"ph = {lit(n)}", joined(_fill(prep.STUDY_POINTERS[n], 300))) for n in _PHASES])
_QUEST = case([(f"ph = {lit(n)}", str(len(prep.QUESTION_SEEDS[n]))) for n in _PHASES])
add("interview_topics", PREP, f""", a AS (SELECT ask.*, EXISTS (SELECT 1 FROM tev WHERE tev.tpl = ask.tpl AND tev.skill = ask.skill) AS shown FROM ask), b AS (
  SELECT *, CASE WHEN kind = 'preferred' THEN 3 WHEN shown THEN 1 ELSE 2 END AS phase FROM a), c AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, profile_id, lower(skill) ORDER BY phase, req_pos, skill_pos) AS n FROM b), d AS (
  SELECT job_id, profile_id, phase, req_pos AS x, skill_pos AS y, skill AS subject, requirement AS ref, shown,
    CASE phase WHEN 1 THEN 'must' WHEN 2 THEN 'must_gap' ELSE CASE WHEN shown THEN 'preferred' ELSE 'preferred_gap' END END AS ph FROM c WHERE n = 1
  UNION ALL SELECT job_id, profile_id, 4, k, 0, duty, left(duty, 500), true, 'duty' FROM pair JOIN (SELECT job_id, unnest(range(0, len(duties[1:5]))) AS k, unnest(duties[1:5]) AS duty FROM jobf) USING (job_id)), e AS (
  SELECT *, row_number() OVER (PARTITION BY job_id, profile_id ORDER BY phase, x, y) AS topic_no FROM d)
  SELECT job_id, profile_id, topic_no, {_TOPIC} AS topic, CASE WHEN shown THEN 'jd' ELSE 'gap' END AS source, md5(left(ref, 500)) AS requirement, {_QUEST} AS questions, md5({_POINT}) AS pointers
  FROM e WHERE topic_no <= 40""")
_STORED_URL = "CASE WHEN doc_id % 4 = 3 THEN 'https://board-global.example/j/' || doc_id ELSE source_url END"
_OFFICIAL = "(doc_id % 4 IN (1, 3))"
add("handoff_queue", RAW, f"""SELECT job_id, {_STORED_URL} AS official_url, {_OFFICIAL} AS url_is_official,
  CASE WHEN source_url IS NULL THEN 'Open the listing on the official portal yourself' WHEN {_OFFICIAL} THEN 'Open the listing on the official portal: ' || ({_STORED_URL})
    ELSE 'Review the listing at source URL: ' || ({_STORED_URL}) END AS first_step, 8 AS steps,
  'screening_answers|salary_declaration|notice_period|personal_information_changes|final_submit' AS human_only,
  CASE WHEN source_url IS NOT NULL AND NOT {_OFFICIAL} THEN 'URL_NOT_OFFICIAL' ELSE '' END AS warnings FROM raw""")

# ---------------------------------------------------------------- store

add("get_postings", RAW, """SELECT job_id, title, CAST(NULL AS INTEGER) AS shown_chars FROM raw WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT job_id, title, length(description) FROM raw WHERE doc_id IN (SELECT doc_id FROM labels)""")
add("find_by_fingerprint", COPIES, "SELECT fp AS fingerprint, min(job_id) AS job_id FROM cp GROUP BY 1")
add("recent", RAW, f"SELECT job_id, {stamp('ingested_at')} AS ingested_at FROM raw ORDER BY raw.ingested_at DESC, job_id DESC LIMIT 500")
_CURSOR = """replace(replace(rtrim(base64(encode('{"ingested_at":"' || strftime(ingested_at, '%Y-%m-%dT%H:%M:%S.%fZ') || '","job_id":"' || job_id || '"}')), '='), '+', '-'), '/', '_')"""


def page(where: str) -> str:
    return f""", pg AS (SELECT *, row_number() OVER (ORDER BY ingested_at DESC, job_id DESC) AS n, count(*) OVER () AS total FROM typed JOIN req USING (job_id) WHERE {where})
  SELECT job_id, provider, title, remote_mode, employment_type, {stamp('ingested_at')} AS ingested_at, retention_class, location_raw, exp_min AS experience_min_years,
    pread AS compensation_disclosed, len(unparsed) AS flag_count, CASE WHEN n = 50 AND total > 50 THEN {_CURSOR} END AS next_cursor FROM pg WHERE n <= 50"""


STORE = [t.RAW_SQL, TYPED_SQL, REQ_SQL]
add("list_postings", STORE, page("remote_mode IN ('remote', 'hybrid') AND retention_class = 'standard_180d'"))
_SEARCH = """lower(title || ' ' || coalesce(company, '') || ' ' || coalesce(location_raw, '') || ' ' || coalesce(city, '') || ' ' || coalesce(country, '')
  || CASE WHEN len(required) + len(preferred) > 0 THEN ' ' || array_to_string(list_concat(required, preferred), ' ') ELSE '' END || ' ' || description)"""
add("search_postings", STORE, page(f"contains({_SEARCH}, 'c++ and c#') AND employment_type IN ('contract', 'full_time')"))
add("keyset_page", RAW, f"""SELECT job_id, {_CURSOR} AS cursor FROM raw WHERE ingested_at < TIMESTAMP '2024-01-10 12:00:00'
  OR (ingested_at = TIMESTAMP '2024-01-10 12:00:00' AND job_id < 'job_00000080-0000-4000-8000-000000000080')""")
add("posting_summary", STORE, f"""SELECT job_id, provider, title, company, remote_mode, employment_type, {stamp('ingested_at')} AS ingested_at, retention_class,
  {_OFFICIAL} AS source_url_is_official, location_raw, exp_min AS experience_min_years, exp_max AS experience_max_years, pread AS compensation_disclosed, len(unparsed) AS flag_count FROM typed""")
add("delete_keys", RAW, """SELECT job_id, 0 AS deleted FROM raw WHERE doc_id NOT IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'total', count(*) FROM raw WHERE doc_id IN (SELECT doc_id FROM labels)""")
_DROP = "CASE WHEN retention_class = 'session' THEN 's' WHEN retention_class = 'standard_180d' AND ingested_at < TIMESTAMP '2024-07-19' - INTERVAL 180 DAY THEN 'e' ELSE 'k' END"
add("apply_retention", RAW, f"""SELECT job_id, 0 AS session_deleted, 0 AS expired_deleted FROM raw WHERE {_DROP} = 'k'
  UNION ALL SELECT 'total', count(*) FILTER ({_DROP} = 's'), count(*) FILTER ({_DROP} = 'e') FROM raw""")
add("table_counts", [], """SELECT 'jobs' AS table_name, count(*) AS row_count FROM documents UNION ALL SELECT 'profiles', count(*) FROM supplier
  UNION ALL SELECT 'audit', count(*) FROM events""")
add("erase_all", [], """SELECT 'jobs' AS table_name, count(*) AS purged, 0 AS left_rows FROM documents UNION ALL SELECT 'profiles', count(*), 0 FROM supplier
  UNION ALL SELECT 'audit', count(*), 1 FROM events""")
add("list_profiles", [t.profile_sql("customer", "c_custkey")], f"SELECT profile_id, label, {stamp('updated_at')} AS updated_at FROM prof")

# ---------------------------------------------------------------- governance

_AGE = "CASE WHEN datediff('day', CAST(snapshot_date AS DATE), CAST(g.at AS DATE)) = -1 THEN 0 ELSE datediff('day', CAST(snapshot_date AS DATE), CAST(g.at AS DATE)) END"
GATE = [t.REQUEST_SQL, t.POLICY_SQL, f"""g0 AS (SELECT g.*, level, status, policy_reason, approval_ref, stale_after_days, {_AGE} AS age FROM request g LEFT JOIN policy USING (provider, capability_id)), gate AS (
  SELECT *, CASE WHEN level IS NULL OR level = 'L4' THEN 'CAPABILITY_DISABLED' WHEN status = 'blocked_by_provider_approval' THEN 'BLOCKED_BY_PROVIDER_APPROVAL'
    WHEN status <> 'enabled' THEN 'CAPABILITY_DISABLED' WHEN level = 'L0' THEN NULL
    WHEN NOT regexp_full_match(coalesce(approval_ref, ''), 'APPROVAL-(BOARD_IN|BOARD_GLOBAL)-\\d{{3}}') THEN 'BLOCKED_BY_PROVIDER_APPROVAL'
    WHEN age < 0 OR age > stale_after_days THEN 'POLICY_STALE' END AS error_code FROM g0)"""]
add("gate_requests", GATE, """SELECT id, capability_id, error_code IS NULL AS allowed, coalesce(level, 'unknown') AS level, coalesce(status, 'disabled') AS status,
  CASE WHEN level IS NULL THEN 'Unknown capability: ' || capability_id WHEN level = 'L4' THEN 'L4 capabilities are strictly disabled in v1'
    WHEN error_code = 'POLICY_STALE' THEN 'Policy snapshot is stale (' || age || ' days old, max allowed is ' || stale_after_days || ' days)' WHEN status = 'enabled' AND level <> 'L0' AND error_code = 'BLOCKED_BY_PROVIDER_APPROVAL'
      THEN 'Capability ''' || capability_id || ''' requires a valid written provider approval reference' ELSE policy_reason END AS reason,
  error_code, approval_ref FROM gate""")
AUDIT = GATE + [f"""aud AS (SELECT id, gate.at AS at, tool, request_id, CASE WHEN error_code IS NULL THEN 'ok' ELSE 'error' END AS outcome, error_code,
  CASE WHEN regexp_full_match(subject_id, '(job|prof)_[0-9a-f-]{{36}}') THEN left(sha256('{q.SALT}' || subject_id), 16) END AS subject_hash FROM gate)"""]
add("audit_rows", AUDIT, f"SELECT id, {stamp('aud.at')} AS at, tool, request_id, outcome, error_code, subject_hash FROM aud")
add("recent_audit", AUDIT, "SELECT id, tool, outcome, error_code FROM aud ORDER BY id DESC LIMIT 1000")
add("outcome_report", AUDIT, "SELECT tool, outcome, error_code, count(*) AS calls FROM aud GROUP BY 1, 2, 3")

# ---------------------------------------------------------------- checks across fields

add("posting_violations", [t.RAW_SQL, TYPED_SQL, REQ_SQL], """SELECT job_id, 'experience_range' AS rule FROM typed WHERE exp_min < exp_max
  UNION ALL SELECT job_id, 'compensation_range' FROM typed WHERE pay_min < pay_max
  UNION ALL SELECT job_id, 'preferred_is_required' FROM req WHERE len(required) > 0
  UNION ALL SELECT job_id, 'flagged_requirement' FROM req WHERE len(flags) > 0""")
add("match_violations", FIT, """SELECT job_id, profile_id, 'unknown_without_score' AS rule FROM fit WHERE n_unknown > 0
  UNION ALL SELECT job_id, profile_id, unnest(['dimension_list', 'blocked_score']) FROM fit WHERE len(blockers) > 0""")

# ---------------------------------------------------------------- streaming

# Every page comes again under another id; pages of the same text meet in the first round already.
add("stream_ingest", [t.PAGE_SQL, f"""judged AS (SELECT *, {VERDICT} AS verdict FROM raw), told AS (SELECT job_id, verdict, CASE WHEN verdict = 'OK' THEN source_url END AS source_url,
  CASE WHEN verdict = 'OK' THEN job_id <> min(job_id) OVER (PARTITION BY verdict, title, description, location) END AS marked FROM judged)"""],
    """SELECT job_id, verdict, source_url, marked FROM told
  UNION ALL SELECT 'job_f' || substr(job_id, 6), verdict, source_url, CASE WHEN verdict = 'OK' THEN true END FROM told""")
add("stream_exact_dedupe", COPIES, "SELECT DISTINCT fp AS fingerprint FROM cp")
add("stream_repeats", COPIES, """SELECT job_id, first_job_id, fp AS fingerprint FROM (
  SELECT job_id, fp, first_value(job_id) OVER (PARTITION BY fp ORDER BY ingested_at, job_id) AS first_job_id FROM cp) WHERE job_id <> first_job_id""")
add("stream_near_dedupe", CLASSES + BATCH[len(COPIES):], """SELECT 'stored' AS scope, job_id, existing_job_id, reason FROM dup
  UNION ALL SELECT 'batch', job_id_b, job_id_a, evidence FROM ev
  UNION ALL SELECT 'batch', cp.job_id, f.first, 'Identical fingerprint: ' || cp.fp FROM cp JOIN (SELECT fp, min(job_id) AS first FROM cp GROUP BY 1) f ON f.fp = cp.fp WHERE cp.job_id <> f.first""")

# A CTE list that continues in the select starts with a comma there.
for _key, _sql in ORACLE.items():
    ORACLE[_key] = _sql.replace(") , ", "), ")

# Tables that several later steps read are computed once.
_SHARED = r"\b(raw|cp|cls|mem|met|near|m0|dup|typed|req|jobf|proff|pf|tev|ask|item1|item2|fit) AS \((?=\s*SELECT)"
for _key, _sql in ORACLE.items():
    ORACLE[_key] = re.sub(_SHARED, r"\1 AS MATERIALIZED (", _sql)
