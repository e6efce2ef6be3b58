"""From a section to its instructions, their plain sentences, and the provenance of every span.

One section is one row all the way: the text goes through a single Arrow UDF and comes back as nested
arrays, so the plan has no shuffle; what needs one row per sentence or record explodes the arrays.
Positions are kept as an edit list, a few numbers for each edit, never one for each character.

A null section text gives null; an empty one no units and the reason "no_units_supplied".
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspan.functions import kernel as k
from lexspan.functions import rules
from lexspan.functions.rendering import Parts, render, section_text, verb_of
from lexspan.runtime import arrow_type, spread

MARKS = r"(?:\(\d{1,2}\)|\([a-z]\))+"
BREAK = "\u0001"


class Edited:
    """A text and where each of its parts stands in the original: runs of (start here, start there)."""

    def __init__(self, text: str, runs: list[tuple[int, int, int]] | None = None):
        self.text = text
        self.runs = runs if runs is not None else [(0, 0, len(text))]
        self.starts = [r[0] for r in self.runs]

    def there(self, i: int) -> int:
        """The place in the original of the character i."""
        if not self.runs:
            return 0
        a, b, n = self.runs[max(0, bisect_right(self.starts, i) - 1)]
        return b + min(i - a, max(n - 1, 0))

    def span(self, a: int, b: int) -> tuple[int, int]:
        at = self.there(a)
        return (at, at) if b <= a else (at, self.there(b - 1) + 1)

    def cut(self, edits: list[tuple[int, int, str]]) -> Edited:
        """With each [a, b) replaced; a replacement stands where the first replaced character stood."""
        if not edits:
            return self
        out: list[str] = []
        runs: list[tuple[int, int, int]] = []
        size = last = 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            at = max(0, bisect_right(self.starts, a) - 1)
            while a < b:
                s, t, n = self.runs[at]
                end = min(b, s + n)
                if end > a:
                    runs.append((size, t + a - s, end - a))
                    size += end - a
                    a = end
                at += 1

        for a, b, new in edits:
            keep(last, a)
            out += [self.text[last:a], new]
            if new:
                runs.append((size, self.there(a), len(new)))
                size += len(new)
            last = b
        keep(last, len(self.text))
        out.append(self.text[last:])
        return Edited("".join(out), runs)

    def sub(self, pattern: str, new: str = "", flags: int = 0, once: bool = False) -> Edited:
        """new may hold \\1 at its start: the first group stays as it is."""
        edits = []
        for m in re.finditer(pattern, self.text, flags):
            if m.end() > m.start():
                edits.append((m.end(1) if new.startswith("\\1") else m.start(), m.end(), new.removeprefix("\\1")))
            if once:
                break
        return self.cut(edits)

    def squeezed(self, least: int) -> Edited:
        inner = self.cut([(m.start(), m.end(), " ") for m in re.finditer(r"\s{%d,}" % least, self.text) if m[0] != " "])
        return inner.cut([(m.start(), m.end(), "") for m in re.finditer(r"\A\s+|\s+\Z", inner.text)])


P_STATE, P_FEDERAL = re.compile(rules.STATE), re.compile(rules.FEDERAL)  # of lower-case text
P_TYPES = [(kind, re.compile(p, re.I)) for kind, p in rules.TYPES]


def section_kind(text: str) -> tuple[str, str | None]:
    for kind, p in P_TYPES:
        if m := p.search(text):
            return kind, " ".join(m[1].split())[:40].rstrip() if kind == "delayed" else None
    return "standard", None


def pieces(text: str) -> list[str]:
    parts = (s.replace(BREAK, "").strip() for s in re.split(rf'(?<=[.!?])\s+(?=[A-Z("{BREAK}])', text))
    return [s for s in parts if len(s) > 15]


def _all(pattern: str, text: str, *needs: str) -> list[str]:
    """All matches; none where the text holds none of the parts that a match needs."""
    low = text.lower()
    return [m[0].strip() for m in re.finditer(pattern, text, re.I)] if not needs or any(n in low for n in needs) else []


def _one(pattern: str, text: str, flags: int = re.I) -> str | None:
    m = re.search(pattern, text, flags)
    return m[0].strip() if m else None


def context(text: str) -> dict:
    """When, where, how and risk of a sentence."""
    low = text.lower()
    state, federal = P_STATE.search(low), P_FEDERAL.search(low)
    return {
        "deadlines": _all(rules.WITHIN, text, "within") + _all(rules.NO_LATER, text, "no later than"),
        "triggers": _all(rules.TRIGGER, text, "upon", "after", "following", "once"),
        "sequence": _all(rules.SEQUENCE, text, "before", "after", "then", "prior to", "subsequent to"),
        "jurisdiction": "Washington State" if state else "Federal" if federal else None,
        "system": "wa_legislature" if state else "federal_law" if federal else None,
        "entity": _one(rules.ENTITY, text, 0),
        "mechanism": _one(rules.MECHANISM, text),
        "enforcement": _one(rules.ENFORCEMENT, text),
    }


NO_CONTEXT = {"deadlines": [], "triggers": [], "sequence": [], "jurisdiction": None, "system": None, "entity": None, "mechanism": None, "enforcement": None}


def risk(text: str) -> dict:
    return {
        "likelihood": _all(rules.LIKELIHOOD, text, "may", "might", "could", "likely", "possible", "probable"),
        "consequences": _all(rules.CONSEQUENCE, text, "result", "subject to", "lead", "cause", "consequence"),
    }


def analyze(original: str, bill_number: int | None = None, verbs: frozenset[str] = k.VERBS) -> dict:
    """Everything of one section: its type, units, lineage and plain meaning.

    detected_type is that of the section's own words. section_type and the prefix are of what comes out: a section
    without units is standard. verbs tell which words may be verbs.
    """
    lineage: list[dict] = []

    def record(parent: int | None, text: str, by: str, span: tuple[int, int] | None, rule: str | None = None, matched: bool = True) -> int:
        failed = span is None or original[span[0] : span[1]] != text
        lineage.append(
            {"id": len(lineage), "parent": parent, "text": text, "produced_by": by, "start": span and span[0], "end": span and span[1], "rule": rule, "matched": matched, "locate_failed": failed}
        )
        return len(lineage) - 1

    at = record(None, original, "root", (0, len(original)))
    t = Edited(original)

    def step(by: str, new: Edited) -> None:
        nonlocal at, t
        at = record(at, new.text, by, new.span(0, len(new.text)), matched=new.text != t.text)
        t = new

    step("strike", t.sub(r"\(\([\s\S]*?\)\)"))
    step("white_space", t.squeezed(1))
    kind, effective = section_kind(t.text)
    step("amendment_header", t.sub(r"\A.*?\b(?:is|are\s+each)\s+amended\s+to\s+read\s+as\s+follows\s*:\s*", flags=re.I, once=True))
    step("new_section_header", t.sub(r"\A.*?\b(?:is|are\s+each)\s+added\s+to\s+(?:chapter|the\s+chapter|title)\b.*?\bto\s+read\s+as\s+follows\s*:\s*", flags=re.I, once=True))
    marked = pieces(t.text)
    if re.search(rf"[;:]\s+{MARKS}", t.text):
        record(at, t.text, "marker_skipped", t.span(0, len(t.text)))
    step("middle_markers", t.sub(rf"(\.\s+){MARKS}\s*", "\\1" + BREAK))
    step("leading_markers", t.sub(rf"\A{MARKS}\s*", once=True))
    step("white_space_runs", t.squeezed(2))

    found = pieces(t.text)
    bound = k.bindings(marked, verbs) if len(marked) == len(found) else [None] * len(found)
    units: list[dict] = []
    cursor = kept = 0
    for text, binding in zip(found, bound):
        place = t.text.find(text, cursor)
        span = t.span(place, place + len(text)) if place >= 0 else None
        cursor = place + len(text) if place >= 0 else cursor
        primary, inner = k.signals(text, verbs)
        opens, defines = bool(k.lead_in(text)), bool(k.P_DEFINES.search(text))
        rule = (
            {"prohibition": "PROHIBITION_RE", "obligation": "OBLIGATION_RE", "permission": "PERMISSION_RE"}[primary] if primary
            else "signal_in_subordinate_clause_only" if inner
            else "list_item_bound_to_lead_in" if binding
            else "list_lead_in_no_requirement_word" if opens
            else "value_definition_no_requirement_word" if defines
            else "no_signal_matched"
        )
        survives = rule != "no_signal_matched"
        own = record(at, text, "sentence_split", span, rule, survives)
        kept += survives
        if survives:
            units += _units(text, primary, inner, binding, kind, bill_number, own, span, record, verbs)
    for n, u in enumerate(units):
        u["unit_no"] = n + 1
    shown, date = (kind, effective) if units else ("standard", None)
    plain, content, why = section_text(shown, date, [u["sentence"] for u in units], len(units))
    return {
        "section_type": shown,
        "effective_date": date,
        "detected_type": kind,
        "input_length": len(t.text),
        "sentence_count": kept,
        "units": units,
        "lineage": lineage,
        "plain_meaning": plain,
        "has_content": content,
        "empty_reason": why,
    }


def _units(text, primary, inner, binding, kind, bill_number, parent, span, record, verbs) -> list[dict]:
    why = k.purpose(text)
    record(parent, text, "constraint_filter", span, why, why is not None)
    if why:
        return []
    norm = k.normalize(text)
    lists, whole = k.inclusions(norm, bill_number), k.instructions(norm, verbs)
    terms = k.values(norm, whole[0].actor)
    short = k.instructions(k.excise(norm, lists), verbs) if any(x.cut for x in lists) else whole
    taken = len(short) >= len(whole) and not any(k.hollow(x.action) for x in short)
    note = "" if taken else " [kept in the sentence]"
    record(parent, text, "inclusion_list_detect", span, ",".join(x.kind for x in lists) + note if lists else "no_marker_found", bool(lists))
    out = []
    entries = [
        {"marker": x.marker, "classification": x.kind, "start": x.start, "end": x.end, "list_text": norm[x.start : x.end] if x.cut else None, "extracted": bool(x.cut) and taken}
        for x in lists
    ]
    noted = [(e["marker"], e["classification"], e["list_text"], e["extracted"]) for e in entries]
    for i, one in enumerate(short if taken else whole):
        inherits = bool(not i and not one.modal and binding)
        actor, modal = binding if inherits else (one.actor, one.modal)
        action = norm if not i and not one.modal and not one.action else one.action
        signal = k.signal_of(one.modal) if i else primary or (k.signal_of(modal) if inherits else None)
        around = NO_CONTEXT if i else context(text)
        missing = ["missing_actor"] * bool(action and not actor) + ["missing_enforcement"] * bool(signal == "obligation" and not around["enforcement"])
        shown = signal or "obligation"
        conditions = [c for c in one.conditions if len(c) > 4]
        parts = Parts(actor, verb_of(modal, shown), modal or "", action, conditions, [d for d in around["deadlines"] if len(d) > 4])
        lens, sentence = render(kind, text, norm, shown, parts, noted)
        out.append(
            {
                "split_no": i, "anchor": text, "signal": signal, "actor": actor, "modal": modal, "action": action, "conditions": one.conditions,
                "subordinate": [] if i else [{"marker": m, "clause_text": c, "signal": s} for m, c, s in inner],
                "inclusion_lists": entries, **around, **({"likelihood": [], "consequences": []} if i else risk(text)),
                "values": [] if i else [{"value_term": v, "resolution_state": s, "resolution_holder": h, "cue": c} for v, s, h, c in terms],
                "missing": missing, "status": "incomplete" if missing else "ok", "lens": lens, "sentence": sentence,
                "start": span and span[0], "end": span and span[1], "lineage_id": parent,
            }
        )
    return out


UNIT = (
    "struct<unit_no:int,split_no:int,anchor:string,signal:string,actor:string,modal:string,action:string,conditions:array<string>,"
    "subordinate:array<struct<marker:string,clause_text:string,signal:string>>,"
    "inclusion_lists:array<struct<marker:string,classification:string,start:int,end:int,list_text:string,extracted:boolean>>,"
    "deadlines:array<string>,triggers:array<string>,sequence:array<string>,jurisdiction:string,system:string,entity:string,mechanism:string,enforcement:string,"
    "likelihood:array<string>,consequences:array<string>,values:array<struct<value_term:string,resolution_state:string,resolution_holder:string,cue:string>>,"
    "missing:array<string>,status:string,lens:string,sentence:string,start:int,end:int,lineage_id:int>"
)
RECORD = "struct<id:int,parent:int,text:string,produced_by:string,start:int,end:int,rule:string,matched:boolean,locate_failed:boolean>"
FIELDS = {
    "section_type": "string", "effective_date": "string", "detected_type": "string", "input_length": "int", "sentence_count": "int", "units": f"array<{UNIT}>",
    "lineage": f"array<{RECORD}>", "plain_meaning": "string", "has_content": "boolean", "empty_reason": "string",
}


def plain_meaning(sections: DataFrame, text: Column | str = "text", bill_number: Column | None = None, fields: Sequence[str] = tuple(FIELDS), verbs: frozenset[str] = k.VERBS) -> DataFrame:
    """Adds the column ``result`` to sections, with those fields of what ``analyze`` finds that are asked for.

    Only they are sent back from Python; an Arrow UDF's result can't be pruned afterwards.
    """
    text = F.col(text) if isinstance(text, str) else text
    number = F.lit(None).cast("int") if bill_number is None else bill_number
    result = "struct<" + ",".join(f"{f}:{FIELDS[f]}" for f in fields) + ">"
    kind = arrow_type(result)

    @F.arrow_udf(result)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            yield pa.array([None if t is None else analyze(t, n, verbs) for t, n in zip(texts.to_pylist(), numbers.to_pylist())], kind)

    # Not to be repeated by the optimizer for a filter on its result.
    return spread(sections).withColumn("result", run.asNondeterministic()(text, number))


def units(analyzed: DataFrame, *keys: str) -> DataFrame:
    return analyzed.select(*keys, F.explode("result.units").alias("u")).select(*keys, "u.*")


def lineage(analyzed: DataFrame, *keys: str) -> DataFrame:
    return analyzed.select(*keys, F.explode("result.lineage").alias("r")).select(*keys, "r.*")


def trace(analyzed: DataFrame, *keys: str) -> DataFrame:
    """(keys, leaf_id, depth, record): every record that reports a sentence, with its ancestors up to the root.

    All sentences of a section have the same parent, the last step of its preamble; so that step's ancestors are walked
    once in the array they come in, and each sentence takes them over. An error if a section breaks that rule.
    """
    nodes = F.col("result.lineage")
    leaves = F.filter(nodes, lambda n: n["produced_by"] == "sentence_split")
    parents = F.array_distinct(F.transform(leaves, lambda n: n["parent"]))
    steps = F.size(F.filter(nodes, lambda n: ~n["produced_by"].isin("sentence_split", "constraint_filter", "inclusion_list_detect")))
    parent_of = lambda i: F.element_at(nodes, i + 1)["parent"]
    up = F.aggregate(
        F.sequence(F.lit(1), steps),
        F.array(F.element_at(parents, 1)),
        lambda acc, _: F.when(parent_of(F.element_at(acc, -1)).isNull(), acc).otherwise(F.concat(acc, F.array(parent_of(F.element_at(acc, -1))))),
    )
    chain = F.transform(up, lambda i: F.element_at(nodes, i + 1))
    whole = (F.size(parents) == 1) & F.element_at(chain, -1)["parent"].isNull()
    rows = analyzed.where(F.size(leaves) > 0).select(*keys, leaves.alias("leaves"), F.when(whole, chain).otherwise(F.raise_error(F.lit("a sentence's lineage doesn't end at the root"))).alias("chain"))
    walk = rows.select(*keys, F.explode("leaves").alias("leaf"), "chain").select(*keys, F.col("leaf.id").alias("leaf_id"), F.posexplode(F.concat(F.array("leaf"), "chain")).alias("depth", "record"))
    return walk
