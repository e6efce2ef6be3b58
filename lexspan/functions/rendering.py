"""Plain-English sentences from the parts of an instruction."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from lexspan.functions import kernel as k
from lexspan.functions.rules import LENSES, NUMBER_WORDS, PERIOD

# Phrases and their plain forms, applied in this order.
PLAIN = [
    ("shall not", "may not"), ("shall", "must"), ("is required to", "must"), ("are required to", "must"),
    ("is authorized to", "may"), ("are authorized to", "may"), ("is prohibited from", "may not"), ("are prohibited from", "may not"),
    ("obligated to", "must"), ("pursuant to", "under"), ("in accordance with", "under"), ("prior to", "before"),
    ("subsequent to", "after"), ("notwithstanding", "despite"), ("in the event that", "if"), ("for the purpose of", "to"),
    ("with respect to", "about"), ("in connection with", "related to"), ("at the time of", "when"), ("provided that", "if"),
    ("in lieu of", "instead of"), ("on behalf of", "for"), ("hereinafter", ""), ("thereafter", "after that"), ("thereof", "of it"),
    ("therein", "in it"), ("thereto", "to it"), ("heretofore", "previously"), ("hereafter", "going forward"),
]
PREFIXES = {"addition": "New law — ", "amendment": "Amends existing law — ", "appropriation": "Funding — "}
REQUIRES = {"must": "requires", "may": "allows", "cannot": "prohibits"}
P_LENSES = [(name, re.compile(p)) for name, p in LENSES]  # of lower-case text
P_PLAIN = [(re.compile(rf"\b{a}\b", re.I), b) for a, b in PLAIN]
P_TIME_TAIL = re.compile(rf"\s+within\s+(?:{NUMBER_WORDS})\s+{PERIOD}[^,;.]*|\s+no later than\s+[^;.]{{3,60}}", re.I)
P_NOTE_LEAD = re.compile(rf"(?:including|excluding)\s*:?\s*(?:,?\s*(?:{'|'.join(f.replace(' ', r'\s+') for f in k.FILLERS)})\s*,?\s*)*", re.I)


@dataclass
class Parts:
    actor: str | None
    verb: str
    raw_modal: str
    action: str | None
    conditions: list[str] = field(default_factory=list)
    deadlines: list[str] = field(default_factory=list)


def finalize(s: str | None) -> str | None:
    s = " ".join((s or "").split())
    return s and s[0].upper() + s[1:] + ("" if s[-1] in ".:" else ".") or None


def lower_first(s: str) -> str:
    return s[:1].lower() + s[1:]


def clean_action(s: str | None) -> str | None:
    s = P_TIME_TAIL.sub("", re.sub(r"^at\s+intervals?\s+[^,]{1,60},\s*", "", s or "", flags=re.I))
    return re.sub(r"[.;,\s]+\Z", "", re.sub(r"^,\s*", "", s)).strip() or None


def verb_of(modal: str | None, signal: str | None) -> str:
    """cannot, must or may; an obligation overrides a modal that only permits."""
    m = (modal or signal or "").lower()
    if signal == "prohibition" or m == "cannot" or re.search("(?:shall|must|may) not", m):
        return "cannot"
    if signal != "obligation" and (m == "may" or "permitted" in m or "authorized" in m or signal == "permission"):
        return "may"
    return "must"


def lens_of(anchor: str, conditions: list[str]) -> str:
    text = f"{anchor} {' '.join(conditions)}".lower()
    return next((name for name, p in P_LENSES if p.search(text)), "modality_shift")


def gerund(action: str) -> str:
    m = re.match(r"\S*", action)
    verb = m[0]
    silent = re.search("[^aeiou]e$", verb, re.I) and not verb.lower().endswith("ee")
    return ((verb[:-1] if silent else verb) + "ing" if verb else "") + action[m.end() :]


def _with(sentence: str, *tails: str | None) -> str:
    """The sentence and those tails that it doesn't hold yet."""
    for t in tails:
        if t and t.lower()[:18] not in sentence.lower():
            sentence += ", " + lower_first(t)
    return sentence


def phrase(lens: str, p: Parts) -> str | None:
    """The sentence of a lens; None where its template doesn't apply."""
    who = re.sub(r",\s*\Z", "", p.actor).strip() if p.actor else None
    act = clean_action(p.action)
    cond = next((c for c in p.conditions if len(c) > 4), None)
    by = next((d for d in p.deadlines if len(d) > 4), None)
    figure = next((c for c in p.conditions if re.search(r"\d", c)), None)
    named = f"{who} {p.verb}" if who else None
    if lens == "obligation_removal":
        are = "are" if re.search(r"\bare\b", p.raw_modal, re.I) else "is"
        s = f"{who or 'This section'} " + (f"{are} no longer required to {act}" if act else "removes a previous requirement")
        return _with(_with(s, by or figure), cond)
    if lens == "actor_power_shift":
        if not who or not act or p.verb == "cannot":
            return None
        if p.verb == "may":
            return _with(f"{named} {act}", cond)
        duty = re.sub(r"^(?:be\s+)?responsible\s+for\s+", "", act, flags=re.I).strip()
        return None if not duty or re.match(r"be\s+\w", duty, re.I) else _with(f"{who} is responsible for {gerund(duty)}", cond)
    if lens == "scope_change":
        if not p.action and not p.actor:
            return None
        subject = who or "This requirement"
        return _with(f"{subject} {p.verb} {act}" if act else f"{subject} applies to everyone involved", cond, by)
    if lens != "modality_shift" and not p.action or not (p.action or p.actor):
        return None
    if lens == "threshold_shift" and act and re.search(r"\bround(?:ed|ing)?\b", act, re.I) and re.search(r"\bcents?\b|\bnickel\b|\bdime\b|\bfive.cent\b", act, re.I):
        cash = re.search("cash|payment|transaction|purchase", f"{(who or '').lower()} {cond or ''}", re.I)
        lead = cond[0].upper() + cond[1:] if cond else "When you pay cash" if cash else f"For {who.lower()}" if who else "In this case"
        return f"{lead}, your total will {act}"
    act = act or ("follow this requirement" if lens == "modality_shift" else "")
    s = f"{named} {act}" if named else f"This section {REQUIRES[p.verb]}: {act}"
    return _with(s, by or figure or cond) if lens == "threshold_shift" else _with(s, cond, by)


def plainify(text: str) -> str | None:
    """The sentence itself with plain words, for where no template applies."""
    s = re.sub(r"^\s*(?:NEW SECTION\.\s+)?Sec\.\s+\d+\.?\s*|^\s*Section\s+\d+[.:)]\s*", "", text, flags=re.I)
    for p, to in P_PLAIN:
        s = p.sub(to, s)
    s = " ".join(s.split())
    m = re.search(r"\b(?:may not|cannot|must|may)\b", s, re.I)
    if not m:
        return None
    subject = re.sub(r"[,\s]+\Z", "", s[: m.start()])
    subject = re.sub(r"^(?:in|on|under|with|for|by|at|to|from|if|when|unless|although|despite|subject to)\s+[^,]{3,},\s*", "", subject, flags=re.I).strip()
    action = re.sub(r";.*\Z", "", re.sub(r"^,\s*[^,]+,\s*", "", s[m.end() :]))
    words = re.sub(r"\.?\s*\Z", "", action).split()
    if not subject or len(subject.split()) > 10 or len(words) < 2:
        return None
    out = f"{subject} {m[0].lower()} {' '.join(words[:25])}{'…' if len(words) > 25 else ''}"
    return finalize(out if len(out) <= 280 else out[:277].rstrip() + "…")


def notes_of(lists: list[tuple[str, str, str | None, bool]]) -> list[str]:
    """Notes of (marker, kind, text, taken out): the examples or exceptions that left the sentence."""
    out = []
    for marker, kind, text, taken in lists:
        if text and taken:
            body = text.strip()
            m = P_NOTE_LEAD.match(body)
            label = "Does not include" if kind == "REVERSED" or marker == "excluding" else "Named examples"
            out.append(f"{label}: {body[m.end() :] if m else body}")
    return out


def _noted(sentence: str | None, notes: list[str]) -> str | None:
    return " ".join([sentence, *[finalize(n) for n in notes]]) if sentence and notes else sentence


def render(section: str, anchor: str, source: str, signal: str | None, p: Parts, lists: list[tuple[str, str, str | None, bool]]) -> tuple[str, str | None]:
    """(lens, sentence) of one instruction."""
    notes = notes_of(lists)
    if section == "repeal":
        who = re.sub(r",\s*\Z", "", p.actor).strip() if p.actor else "This section"
        return "repeal", _noted(finalize(f"{who} {'are' if re.search(r'\b(?:sections|are)\b', who, re.I) else 'is'} no longer in effect"), notes)
    if section == "appropriation":
        return "appropriation", _noted(finalize(_funding(anchor, p)), notes)
    lens = lens_of(anchor, p.conditions)
    status, parts = k.clauses(p.actor, p.raw_modal, p.action, source)
    if parts:
        subject = k.status_subject(status) if status else None
        done = []
        for i, (text, modal) in enumerate(parts):
            one = replace(p, actor=subject if status else p.actor, verb=verb_of(modal, None), raw_modal=modal, action=text)
            s = finalize(phrase(lens, one if not i else replace(one, conditions=[], deadlines=[])))
            if s and not i and status and not subject:
                s = finalize(f"Because {lower_first(clean_action(status) or status)}, {lower_first(re.sub(r'\.\s*\Z', '', s))}")
            if s:
                done.append(s)
        if done:
            done[0] = _noted(done[0], notes)
        return lens, "\n\n".join(done) or None
    made = finalize(phrase(lens, p))
    plain = None if made else plainify(anchor)
    return ("fallback" if plain else lens), _noted(made or plain, notes)


def _funding(anchor: str, p: Parts) -> str:
    amount = re.search(r"\$[\d,]*\d(?:\.\d{2})?", anchor)
    if not amount:
        act = clean_action(p.action)
        return f"Funding is appropriated {act}" if act else "Funding is appropriated for this purpose"
    what = re.search(r"\bfor\s+(?:the\s+)?purposes?\s+of\s+([^,;.]{4,60})", anchor, re.I) or re.search(r"\bfor\s+(?:the\s+)?(?!biennium|expenditure|purposes?)([^,;.]{4,60})", anchor, re.I)
    to = re.search(r"\bto\s+((?:the\s+)?(?:department|agency|office|board|commission)\s+of\s+[^,;.]{4,40}?)(?:\s+for\b|,|;|\.)", anchor, re.I)
    return f"{amount[0]} is allocated" + (f" to {to[1].strip()}" if to else "") + (f" for {what[1].strip()}" if what else "")


def section_text(section: str, effective: str | None, sentences: list[str | None], n_units: int) -> tuple[str, bool, str | None]:
    """(plain meaning, has content, why it is empty): each sentence once, under the section's prefix."""
    kept = list(dict.fromkeys(s for s in sentences if s))
    prefix = f"Effective {effective} — " if section == "delayed" and effective else PREFIXES.get(section, "")
    none = "This section is repealed and no longer in effect." if section == "repeal" else "No obligation or change detected in this section."
    why = None if kept else "all_units_dropped" if n_units else "no_units_supplied"
    return prefix + ("\n\n".join(kept) or none), bool(kept) or section == "repeal", why
