"""Rules over one sentence or section as Column expressions, and the word lists they are built of."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspan.functions.text import squeeze, trim

# Word lists, fixed values: results depend on exactly these.
PROHIBITION = ["may not", "must not", "shall not", "cannot", "is prohibited", "are prohibited", "prohibited from"]
OBLIGATION = [
    "shall", "must", "required to", "is required", "are required", "obligated to", "is responsible for",
    "are responsible for", "is repealed", "are each repealed", r"is(?:\s+hereby)?\s+appropriated",
]
PERMISSION = ["may", "permitted to", "authorized to", "is allowed"]
PURPOSE = [
    ("intends_to", r"\bintends?\s+to\b"), ("seeks_to", r"\bseeks?\s+to\b"), ("aims_to", r"\baims?\s+to\b"),
    ("designed_to", r"\bdesigned\s+to\b"), ("purpose_is_to", r"\bpurpose\s+is\s+to\b"),
]
MODALS = [
    "is no longer required to", "are no longer required to", "is responsible for", "are responsible for",
    "are each repealed", "is repealed", r"is(?:\s+hereby)?\s+appropriated", "shall not", "must not", "may not",
    r"(?:is|are)\s+(?:\w+\s+)?obligated to", "obligated to", "shall", "must", "may", "cannot", "is required to", "are required to",
]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
NUMBER_WORDS = r"\d+|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty|forty|fifty|sixty|ninety|one hundred"
PERIOD = r"(?:business\s+)?(?:days?|months?|years?|hours?|weeks?)"
# Patterns, fixed values too; the Columns below and the scan of ``plans.plain_meaning`` are built of the same ones.
DATED = rf"\b(?:effective|takes?\s+effect)\s+([^.;\n]{{0,60}}?(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}})"
TYPES = [
    ("addition", r"\bNEW\s+SECTION\b"), ("amendment", r"\bis\s+amended\s+to\s+read\s+as\s+follows\b"), ("repeal", r"\b(?:are\s+each\s+repealed|is\s+repealed)\b"),
    ("delayed", DATED), ("appropriation", r"\bis\s+(?:hereby\s+)?appropriated\b|\bsum\s+of\s+\$"),
]
WITHIN, NO_LATER = rf"within\s+(?:{NUMBER_WORDS})\s+{PERIOD}", r"no later than\s+[^;.]{3,60}"
TRIGGER, SEQUENCE = r"(?:upon|after|following|once)\s+[^,;.]{4,60}", r"(?:before|after|then|prior to|subsequent to)\s+[^,;.]{4,60}"
STATE, FEDERAL = r"\b(?:rcw|revised code of washington|washington state|wa legislature)\b", r"\b(?:congress|federal|u\.s\.|cfr|u\.s\.c\.)\b"
ENTITY = r"\b(?:the\s+)?(?:department|agency|commission|board|office|secretary|director|officer|authority)\s+of\s+[A-Z][A-Za-z\s]{2,40}"
MECHANISM = r"\b(?:by|through|via|using|pursuant to)\s+[^,;.]{4,80}"
ENFORCEMENT = r"\b(?:penalty|fine|violation|failure to comply|subject to\s+(?:a\s+)?(?:fine|penalty)|enforcement)\b[^.;]*"
LIKELIHOOD = r"\b(?:may|might|could|likely|possible|probable)\b[^,;.]{0,60}"
CONSEQUENCE = r"\b(?:resulting? in|subject to|leading? to|cause[sd]?|consequence)\b[^,;.]{0,60}"
LENSES = [
    ("obligation_removal", r"\b(?:no longer required|not required|no obligation|(?:requirement|obligation|restriction|prohibition|fee)s?\s+(?:is|are|has been|have been|was|were)\s+(?:removed|waived|exempted|eliminated)|no longer\s+\w+)\b"),
    ("threshold_shift", r"\b(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty|forty|fifty|sixty|ninety)\s*(?:percent|%|business days?|days?|months?|years?|hours?|weeks?)\b|\bno (?:less|more|fewer) than\b|\bat (?:least|most)\b|\bminimum\b|\bmaximum\b|\bno later than\b|\bthreshold\b|\bstandard\b|\b(?:round(?:ed|ing)|adjust(?:ed|ing|ment))\b"),
    ("actor_power_shift", r"\b(?:responsible for|authority|authorized to|delegat(?:ed|e|ion)|approved by|reports\s+to|in consultation with|under the direction of)\b"),
    ("action_domain_shift", r"\b(?:inspect(?:ion)?|audit|review|assess(?:ment)?|monitor(?:ing)?|certif(?:y|ied|ication)|submit(?:ting)?|conduct|perform|train(?:ing)?|document(?:ation)?|implement|maintain(?:ance)?)\b"),
    ("scope_change", r"\bthroughout\b|\bacross all\b|\ball covered\b|\bapplies?\s+to\b|\bregardless of\b"),
]


def any_word(words: list[str]) -> str:
    return r"\b(?:" + "|".join(words) + r")\b"


def has(c: Column, pattern: str) -> Column:
    return F.regexp_like(c, F.lit("(?i)" + pattern))


def first(c: Column, pattern: str, group: int = 0, ignore_case: bool = True) -> Column:
    """The first match, trimmed; null if there is none."""
    return F.nullif(trim(F.regexp_extract(c, ("(?i)" if ignore_case else "") + pattern, group)), F.lit(""))


def every(c: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("(?i)" + pattern), F.lit(0)), trim)


def signal(c: Column) -> Column:
    """prohibition, else obligation, else permission, else null."""
    return F.when(has(c, any_word(PROHIBITION)), "prohibition").when(has(c, any_word(OBLIGATION)), "obligation").when(has(c, any_word(PERMISSION)), "permission")


def section_type(c: Column) -> Column:
    """struct<type, effective_date>: the first of six rules that holds."""
    date = F.regexp_replace(F.regexp_extract(c, "(?i)" + DATED, 1), r"\s+", " ")
    kind = reduce(lambda acc, r: acc.when(has(c, r[1]), r[0]), TYPES[1:], F.when(has(c, TYPES[0][1]), TYPES[0][0])).otherwise("standard")
    return F.struct(kind.alias("type"), F.when(kind == "delayed", trim(F.substring(trim(date), 1, 40))).alias("effective_date"))


def purpose_rule(c: Column) -> Column:
    """The first rule by which a sentence only states a purpose; null if none."""
    return reduce(lambda acc, r: acc.when(has(c, r[1]), r[0]), PURPOSE[1:], F.when(has(c, PURPOSE[0][1]), PURPOSE[0][0]))


def normalize(c: Column) -> Column:
    """Without a section heading, white space collapsed."""
    head = F.regexp_replace(c, r"(?i)^\s*(?:NEW SECTION\.\s+)?Sec\.\s+\d+\.?\s*", "")
    return squeeze(F.regexp_replace(head, r"(?i)^\s*Section\s+\d+[.:)]\s*", ""))


def modal(c: Column) -> Column:
    return F.lower(first(c, r"\b(?:" + "|".join(MODALS) + r")\b"))


def deadlines(c: Column) -> Column:
    return F.concat(every(c, WITHIN), every(c, NO_LATER))


def triggers(c: Column) -> Column:
    return every(c, TRIGGER)


def sequence(c: Column) -> Column:
    return every(c, SEQUENCE)


def jurisdiction(c: Column) -> Column:
    """struct<jurisdiction, system, entity>."""
    state, federal = has(c, STATE), has(c, FEDERAL)
    entity = first(c, ENTITY, ignore_case=False)
    return F.struct(
        F.when(state, "Washington State").when(federal, "Federal").alias("jurisdiction"),
        F.when(state, "wa_legislature").when(federal, "federal_law").alias("system"),
        entity.alias("entity"),
    )


def mechanism(c: Column) -> Column:
    return first(c, MECHANISM)


def enforcement(c: Column) -> Column:
    return first(c, ENFORCEMENT)


def likelihood(c: Column) -> Column:
    return every(c, LIKELIHOOD)


def consequences(c: Column) -> Column:
    return every(c, CONSEQUENCE)


def lens(anchor: Column, conditions: Column) -> Column:
    """The first lens whose words stand in the anchor or its conditions."""
    text = F.concat_ws(" ", anchor, F.array_join(conditions, " "))
    return reduce(lambda acc, r: acc.when(has(text, r[1]), r[0]), LENSES[1:], F.when(has(text, LENSES[0][1]), LENSES[0][0])).otherwise("modality_shift")


def modal_verb(word: Column, kind: Column) -> Column:
    """cannot, must or may of a modal and a signal; an obligation overrides a modal that only permits."""
    m = F.lower(F.coalesce(word, kind, F.lit("")))
    return (
        F.when(has(m, r"(?:shall|must|may) not") | (m == "cannot") | (F.coalesce(kind, F.lit("")) == "prohibition"), "cannot")
        .when(kind == "obligation", "must")
        .when((m == "may") | m.contains("permitted") | m.contains("authorized") | (kind == "permission"), "may")
        .otherwise("must")
    )


def signal_of_modal(m: Column) -> Column:
    return F.when((m == "cannot") | has(m, r"\bnot\b"), "prohibition").when(m == "may", "permission").when(m.isNotNull(), "obligation")


def finalize(c: Column) -> Column:
    """Collapsed, first letter upper case, ending in a full stop or colon; null stays null."""
    s = squeeze(c)
    full = F.when(s.endswith(".") | s.endswith(":"), s).otherwise(F.concat(s, F.lit(".")))
    return F.when(F.length(c) > 0, F.concat(F.upper(F.substring(full, 1, 1)), F.substring(full, 2, 1 << 30)))
