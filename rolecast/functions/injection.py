"""Advisory scan for text that tries to instruct a reader's tools."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecast.functions.regex import mentions

# Signal id, pattern, flags; reported in this order. The last entry lists text a
# match is sure to contain ('' for none).
SIGNALS = (
    ("override_ignore_instructions", r"\b(?:ignore|disregard|forget|bypass)\s+(?:all\s+|any\s+)?(?:(?:previous|prior|above|system)\s+)?instructions\b", "i", "instructions"),
    ("override_rules_guidelines", r"\b(?:ignore|disregard|forget|bypass|override)\s+(?:all\s+|any\s+)?(?:rules|guidelines|policies|constraints)\b", "i", "rules|guidelines|policies|constraints"),
    ("override_prompt_reset", r"\b(?:reset|clear|erase)\s+(?:your\s+)?(?:instructions|context|memory|system\s+prompt)\b", "i", "instructions|context|memory|prompt"),
    ("override_start_over", r"\bstart\s+over\s+and\s+(?:follow|obey|execute)\b", "i", "start"),
    ("role_hijack_you_are_now", r"\byou\s+are\s+now\s+(?:an?|the|a\s+new)\b", "i", "now"),
    ("role_hijack_act_as", r"\bact\s+as\s+(?:an?|the)\s+(?:unrestricted|evil|dan|developer|root|admin|hacker|bot|assistant)\b", "i", "act"),
    ("role_hijack_developer_mode", r"\bdeveloper\s+mode\s+(?:is\s+)?(?:enabled|activated|on)\b", "i", "developer"),
    ("role_hijack_dan_jailbreak", r"\b(?:DAN\s+mode|jailbreak\s+mode|unfiltered\s+mode)\b", "i", "mode"),
    ("role_hijack_system_prompt_leak", r"\b(?:print|reveal|show|dump|output)\s+(?:the\s+)?(?:system\s+prompt|initial\s+instructions)\b", "i", "prompt|instructions"),
    ("tool_steering_call_tool", r"\b(?:call|invoke|execute|run)\s+(?:the\s+)?(?:tool|function|plugin|mcp_tool)\b", "i", "tool|function|plugin"),
    ("tool_steering_use_tool", r"\buse\s+(?:the\s+)?(?:tool|command|shell|exec|api)\b", "i", "tool|command|shell|exec|api"),
    ("tool_steering_send_email", r"\b(?:send|forward|dispatch)\s+(?:an?\s+)?(?:email|cv|resume|profile|attachment)\s+to\b", "i", "send|forward|dispatch"),
    ("tool_steering_forward_data", r"\bforward\s+(?:this|the|all|user)\s+(?:data|cv|resume|token|secret|details)\s+to\b", "i", "forward"),
    ("tool_steering_delete_all", r"\b(?:delete|drop|purge|wipe|destroy)\s+(?:all\s+)?(?:data|database|files?|profiles?|jobs?)\b", "i", "delete|drop|purge|wipe|destroy"),
    ("tool_steering_upload_exfil", r"\bupload\s+(?:the\s+)?(?:file|data|database|secrets?|tokens?|cv)\s+to\b", "i", "upload"),
    ("chat_template_im_start", r"<\|im_start\|>", "i", "im_"),
    ("chat_template_im_end", r"<\|im_end\|>", "i", "im_"),
    ("chat_template_inst", r"\[/?INST\]", "i", "inst]"),
    ("chat_template_system_header", r"###\s*system\b", "i", "###"),
    ("chat_template_assistant_header", r"###\s*assistant\b", "i", "###"),
    ("chat_template_human_header", r"###\s*human\b", "i", "###"),
    ("chat_template_role_prefix", r"^(?:system|assistant|human):\s*", "im", "system:|assistant:|human:"),
    ("markdown_exfil_image_query", r"!\[[^\]]*\]\(https?://[^\s)]+\?[^\s)]+\)", "i", "](http"),
    ("markdown_exfil_link_query", r"\[[^\]]*\]\(https?://[^\s)]+\?[^\s)]*(?:data|exfil|cv|token|key|cookie)=", "i", "](http"),
    ("base64_blob_large", r"[A-Za-z0-9+/]{200,}={0,2}", "", ""),
    ("multilingual_hindi_forget_instructions", r"पिछले\s+(?:सभी\s+)?निर्देश\s+(?:भूल\s+जाओ|अनदेखा\s+करें)", "", "निर्देश"),
    ("multilingual_hindi_follow_new", r"नए\s+निर्देश\s+का\s+पालन\s+करें", "", "निर्देश"),
    ("multilingual_tamil_ignore_instructions", r"முந்தைய\s+வழிமுறைகளை\s+புறக்கணிக்கவும்", "", "வழிமுறைகளை"),
    ("multilingual_tamil_forget_instructions", r"முந்தைய\s+வழிமுறைகளை\s+மறந்து\s+விடுங்கள்", "", "வழிமுறைகளை"),
    ("delimiter_prompt_injection", r"(?:---|\*\*\*|===)\s*(?:START|END)\s+(?:PROMPT|INSTRUCTION|SYSTEM)", "i", "prompt|instruction|system"),
)


def injection_signals(text: Column) -> Column:
    """Ordered ids of all signals found in ``text``."""
    def scan(both: Column) -> Column:
        hits = [
            F.when(mentions(both.text, both.lower, needles, pattern, flags), F.lit(name))
            for name, pattern, flags, needles in SIGNALS
        ]
        return F.filter(F.array(*hits), lambda s: s.isNotNull())

    # A one-element transform names the lower-case text, so it is computed once.
    both = F.struct(text.alias("text"), F.lower(text).alias("lower"))
    return F.transform(F.array(both), scan)[0]
