"""SQL that states what the queries must give, written from the specification and not from the library's constants."""

from __future__ import annotations

#: White space of the source dialect, as an RE2 class.
WS = r"[\s\v\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def has(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, {quoted('(?i)' + pattern)})"


def first(c: str, pattern: str, group: int = 0, flags: str = "(?i)") -> str:
    return f"nullif({trimmed(f'regexp_extract({c}, {quoted(flags + pattern)}, {group})')}, '')"


def every(c: str, pattern: str) -> str:
    return f"list_transform(regexp_extract_all({c}, {quoted('(?i)' + pattern)}), lambda m: {trimmed('m')})"


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def squeezed(c: str, least: int = 1) -> str:
    return trimmed(f"regexp_replace({c}, '{WS}{{{least},}}', ' ', 'g')")


def split(source: str, least: int, starts: str) -> str:
    """Sentences by inserting a mark after each sentence end and splitting at it."""
    parts = f"string_split(regexp_replace({source}, '([.!?])\\s+([{starts}])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    return f"list_filter(list_transform({parts}, lambda x: {trimmed('x')}), lambda x: length(x) > {least})"


#: Sections of a text: a mark before each heading line, parts of more than 20 characters, else the whole text.
def cut_sections(text: str) -> str:
    parts = f"string_split(regexp_replace({text}, '(^|\\n)([ \\t]*(?:NEW SECTION\\.\\s+)?Sec\\.\\s+\\d+\\.)', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
    found = f"list_filter(list_transform({parts}[2:], lambda x: {trimmed('x')}), lambda x: length(x) > 20)"
    return f"CASE WHEN len({found}) > 0 THEN {found} ELSE [{trimmed(text)}] END"


SECTIONS = f"""entries AS (
  SELECT entry_id, bill_number, CASE WHEN len(sections) > 0 THEN list_transform(sections, lambda x: x.text)
    WHEN length({trimmed("text")}) > 0 THEN {cut_sections("text")} END AS texts FROM bill_corpus),
s AS (SELECT entry_id, bill_number, unnest(range(len(texts)))::INT AS section_pos, unnest(texts) AS text FROM entries WHERE texts IS NOT NULL)"""

SENTENCES = (
    SECTIONS
    + f""", l AS (SELECT entry_id, section_pos, {split(squeezed("text"), 15, 'A-Z("')} AS l FROM s WHERE text IS NOT NULL),
sent AS (SELECT entry_id, section_pos, unnest(range(len(l)))::INT AS pos, unnest(l) AS sentence FROM l)"""
)

SIGNAL = (
    r"CASE WHEN regexp_matches(sentence, '(?i)\b(?:(?:may|must|shall) not|cannot|(?:is|are) prohibited|prohibited from)\b') THEN 'prohibition' "
    r"WHEN regexp_matches(sentence, '(?i)\b(?:shall|must|(?:is|are) required|required to|obligated to|(?:is|are) responsible for|is repealed|are each repealed|is\s+appropriated|is\s+hereby\s+appropriated)\b') THEN 'obligation' "
    r"WHEN regexp_matches(sentence, '(?i)\bmay\b|\b(?:permitted|authorized) to\b|\bis allowed\b') THEN 'permission' END"
)
#: The leftmost modal, and of those that start at one place the one listed first; so the long forms come before their beginnings.
MODAL = (
    r"lower(nullif(regexp_extract(sentence, '(?i)\b(?:(?:is|are) no longer required to|(?:is|are) responsible for|are each repealed|is repealed|is(?:\s+hereby)?\s+appropriated"
    r"|(?:shall|must|may) not|(?:is|are)\s+(?:\w+\s+)?obligated to|obligated to|shall|must|may|cannot|(?:is|are) required to)\b'), ''))"
)
DATE = r"\b(?:effective|takes?\s+effect)\s+([^.;\n]{0,60}?(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4})"


def section_type(c: str) -> str:
    return (
        f"CASE WHEN {has(c, r'\bNEW\s+SECTION\b')} THEN 'addition' WHEN {has(c, r'\bis\s+amended\s+to\s+read\s+as\s+follows\b')} THEN 'amendment' "
        f"WHEN {has(c, r'\b(?:are\s+each|is)\s+repealed\b')} THEN 'repeal' WHEN {has(c, DATE)} THEN 'delayed' "
        f"WHEN {has(c, r'\bis\s+appropriated\b|\bis\s+hereby\s+appropriated\b|\bsum\s+of\s+\$')} THEN 'appropriation' ELSE 'standard' END"
    )


PURPOSES = (
    r"CASE WHEN regexp_matches(sentence, '(?i)\bintends? to\b') THEN 'intends_to' WHEN regexp_matches(sentence, '(?i)\bseeks? to\b') THEN 'seeks_to' WHEN regexp_matches(sentence, '(?i)\baims? to\b') THEN 'aims_to' "
    r"WHEN regexp_matches(sentence, '(?i)\bdesigned to\b') THEN 'designed_to' WHEN regexp_matches(sentence, '(?i)\bpurpose is to\b') THEN 'purpose_is_to' END"
)
_NUMBER = r"(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten|fifteen|twenty|thirty|forty|fifty|sixty|ninety"
WITHIN = rf"within\s+{_NUMBER}|one hundred)\s+(?:business\s+)?(?:day|month|year|hour|week)s?"
LENS = (
    "CASE WHEN "
    + has("sentence", r"\b(?:no longer required|not required|no obligation|(?:requirement|obligation|restriction|prohibition|fee)s?\s+(?:is|are|has been|have been|was|were)\s+(?:removed|waived|exempted|eliminated)|no longer\s+\w+)\b")
    + " THEN 'obligation_removal' WHEN "
    + has("sentence", rf"\b{_NUMBER})\s*(?:percent|%|(?:business )?days?|months?|years?|hours?|weeks?)\b|\bno (?:less|more|fewer|later) than\b|\bat (?:least|most)\b|\b(?:min|max)imum\b|\bthreshold\b|\bstandard\b|\bround(?:ed|ing)\b|\badjust(?:ed|ing|ment)\b")
    + " THEN 'threshold_shift' WHEN "
    + has("sentence", r"\bresponsible for\b|\bauthority\b|\bauthorized to\b|\bdelegat(?:e|ed|ion)\b|\bapproved by\b|\breports\s+to\b|\bin consultation with\b|\bunder the direction of\b")
    + " THEN 'actor_power_shift' WHEN "
    + has("sentence", r"\b(?:inspect|inspection|audit|review|assess|assessment|monitor|monitoring|certify|certified|certification|submit|submitting|conduct|perform|train|training|document|documentation|implement|maintain|maintenance)\b")
    + " THEN 'action_domain_shift' WHEN "
    + has("sentence", r"\bthroughout\b|\bacross all\b|\ball covered\b|\bapplies?\s+to\b|\bregardless of\b")
    + " THEN 'scope_change' ELSE 'modality_shift' END"
)
#: Multi-label classes of a sentence x, in their order.
CLASSES = (
    "list_filter(["
    + ", ".join(
        f"CASE WHEN {test} THEN '{name}' END"
        for name, test in (
            ("prohibition", has("x", r"\b(?:(?:may|must|shall) not|prohibited from|is prohibited)\b")),
            ("obligation", has("x", r"\b(?:must|shall|required to)\b")),
            ("permission", has("x", r"\bmay\b") + " AND NOT " + has("x", r"\bmay not\b")),
            ("condition", has("x", r"\b(?:if|unless|when|provided that|subject to)\b")),
            ("exception", has("x", r"\b(?:except|exception|does not apply|notwithstanding)\b")),
            ("definition", has("x", r"\b(?:means|(?:is|are) defined as|definition)\b")),
            ("reference", has("x", r"\b(?:RCW|executive order|federal law|court order|agency|department|Nlets|ACCESS|DAPS)\b")),
        )
    )
    + "], lambda z: z IS NOT NULL)"
)
REFERENCES = [
    ("rcw", r"\bRCW\s+[0-9A-Za-z.]+(?:\s+[0-9A-Za-z.()]+)?"), ("executive_order", r"\b(?:governor'?s\s+)?executive order\b[^.;]*"),
    ("federal_law", r"\bfederal law\b[^.;]*"), ("court_order", r"\bcourt order\b[^.;]*"), ("system", r"\b(?:Nlets|ACCESS|DAPS)\b"),
]
SELECTED = (
    SECTIONS
    + f""", l AS (SELECT entry_id, section_pos, {split(squeezed("text"), 20, "A-Z(")} AS l FROM s WHERE text IS NOT NULL),
x AS (SELECT entry_id, section_pos, unnest(range(len(l)))::INT AS pos, unnest(l) AS x FROM l),
c AS (SELECT *, {CLASSES} AS types FROM x),
sel AS (SELECT *, list_filter(['prohibition', 'obligation', 'permission', 'definition', 'condition', 'exception', 'reference'], lambda p: list_contains(types, p))[1] AS primary_type FROM c WHERE len(types) > 0)"""
)
#: Record types by ranges of the bill number n: (first, last, abbreviation, type, chamber).
RANGES = """(1000, 3999, 'HB', 'House Bill', 'House'), (5000, 7999, 'SB', 'Senate Bill', 'Senate'), (4000, 4199, 'HJM', 'House Joint Memorial', 'House'), (8000, 8199, 'SJM', 'Senate Joint Memorial', 'Senate'),
(4200, 4399, 'HJR', 'House Joint Resolution', 'House'), (8200, 8399, 'SJR', 'Senate Joint Resolution', 'Senate'), (4400, 4599, 'HCR', 'House Concurrent Resolution', 'House'), (8400, 8599, 'SCR', 'Senate Concurrent Resolution', 'Senate'),
(4600, 4999, 'HR', 'House Resolution', 'House'), (8600, 8999, 'SR', 'Senate Resolution', 'Senate'), (9000, 9999, 'SGA', 'Senate Gubernatorial Appointment', 'Senate')"""
