"""Tags of suspicious requests: one alternation per tag, so a text is scanned once for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns of each tag, without case, ^ at any line.
TAGS: dict[str, list[str]] = {
    "role_override": [r"\byou are now\b", r"\bact as (a|an|the)\b", r"\bpretend (to be|you are)\b", r"\bfrom now on,?\s+you\b", r"\byou are no longer\b", r"\byour new (role|persona)\b", r"^\s*(system|assistant)\s*:"],
    "system_prompt_extraction": [r"\bsystem prompt\b", r"\breveal\b.{0,30}\b(instructions|prompt|directives|password)\b", r"\binternal directives\b", r"\bmaster password\b", r"\binitial prompt\b",
        r"\bprint\b.{0,20}\b(your instructions|the system prompt)\b", r"\bwhat (are|is) your (instructions|system prompt)\b", r"\bshow me your (prompt|instructions)\b", r"\bexpose\b.{0,25}\b(internal|hidden|secret)\b"],
    "instruction_ignore": [r"\bignore (the |all |any )?(previous|prior|above)\b", r"\bdisregard\b", r"\bforget (the above|what you know|everything)\b", r"\boverride (your |the )?instructions\b", r"\bstart from scratch\b",
        r"\bfrom the outset\b", r"\breboot\b", r"\brelaunch from zero\b", r"\bresume from the start\b", r"\bbegin anew\b", r"\bfrom square one\b", r"\bwipe the slate clean\b", r"\bclean slate\b"],
    "encoding_smuggling": [r"(?:\\u[0-9a-fA-F]{4}){3,}", r"(?:%[0-9a-fA-F]{2}){3,}", r"(?:\\x[0-9a-fA-F]{2}){3,}", r"[\x{200B}\x{200C}\x{200D}\x{FEFF}]", r"\bxn--"],
    "roleplay_jailbreak": [r"\bDAN\b", r"\bjailbreak\b", r"\bdo anything now\b", r"\bhypothetical scenario\b", r"\bfictional story\b", r"\brole[- ]?play\b", r"\bno restrictions\b", r"\bwithout any (restrictions|limitations|filters)\b", r"\bas an ai with no\b"],
    "translation_wrapper": [r"\btranslate (the following|this)\b", r"\brespond (only )?in (french|spanish|german|chinese|russian|japanese|italian)\b", r"\bin (french|spanish|german|chinese|russian|japanese|italian),?\s+(then|and)\b", r"\btraduis\b", r"übersetze\b"],
    "code_block_smuggling": [r"```", r"\bdef\s+\w+\s*\(", r"\bfunction\s*\w*\s*\(", r"console\.log\(", r"System\.out\.println", r"\bprintln!\("],
}
#: A run that looks encoded, and the two halves of a harmful request.
ENCODED = r"(?:[A-Za-z0-9+/]{4}){8,}={0,2}"
HARM = (r"hack|steal|stealing|exploit|weapon|firearm|bomb|virus|malware|trojan horse|kill|murder|poison|drugs online|embezzle|fraud|stalk|harass|counterfeit|phishing|launder|traffick|slavery|self-harm|suicide|spy on|drone|"
    r"bypass security|circumvent (government )?(censorship|surveillance)|unauthorized access|ransomware|credit card|social security number|identity theft|hijack|cyberattack|cyber attack|heist|enter a country illegally|"
    r"classified information|manipulate financial markets|insurance fraud|terrorist|government database|break into|human trafficking|destroy.{0,20}(computers|data)|lie detector|synthesize a (nerve|toxic)")
ASKED = r"^\s*(write|create|develop|describe|explain|outline|generate|give (me )?|provide (me )?|tell me how to|design|compose|draft|produce|plan|program|teach me|help me|show)\b"
NAMES = sorted([*TAGS, "obfuscation_base64", "direct_harmful_request"])


def flags(text: Column) -> dict[str, Column]:
    """A boolean of each tag; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    out = {tag: F.rlike(t, F.lit("(?im)" + "|".join(patterns))) for tag, patterns in TAGS.items()}
    out["obfuscation_base64"] = F.exists(F.regexp_extract_all(t, F.lit(ENCODED), F.lit(0)), lambda x: (F.length(x) >= 32) & x.rlike("[0-9]") & x.rlike("[A-Z]"))
    out["direct_harmful_request"] = F.rlike(t, F.lit("(?im)" + ASKED)) & F.rlike(t, F.lit("(?i)" + HARM))
    return {tag: out[tag] for tag in NAMES}


def tags(text: Column) -> Column:
    """Sorted array of the tags found."""
    return F.array_compact(F.array(*[F.when(flag, F.lit(tag)) for tag, flag in flags(text).items()]))
