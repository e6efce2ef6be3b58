"""Languages of documents and of their segments, by compression with per-language dictionaries.

Each language has a zstandard raw-content dictionary. A stretch of text is encoded with every one
of them, and the language whose dictionary makes it smallest wins. A text is first cut into units,
at sentence ends, line breaks, separators and round brackets; each unit is encoded with all dictionaries, and the
sequence of languages with the least total size, where every change costs ``SWITCH`` bytes, is found
by dynamic programming; neighbouring units of one language form a segment. Units that are mostly
figures or signs belong to no language and end a segment; line breaks don't. A segment is rejected
(language null) where the margin between the smallest size and the next is less than ``NARROW``
of the smallest; the confidence is that margin over the next size.

The dictionaries are made of the labelled sample texts and of a bounded sample of documents with a
known label: at most ``PER_LANGUAGE`` a language of at most ``SAMPLE_CHARS`` characters, chosen by the
hash of the id, and only those whose
label the samples' dictionaries confirm. A unit goes to the language most of whose documents hold it.
The dictionaries hold at most ``DICTIONARY`` bytes. All documents are then labelled, whole texts, in one pass without a
shuffle.

Null and empty texts have no segment and the document's language null. Texts are compared in lower
case, without accents, and with runs of digits as one.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspan.core.snapshots import SPACE
from lexspan.runtime import arrow_type, small, spread

PER_LANGUAGE, SAMPLE_CHARS, DICTIONARY = 60, 20_000, 48 * 1024
#: Spellings of labels that there may be.
MAX_FORMS = 100_000
SWITCH, NARROW, LONG_UNIT, CACHE, FOREIGN = 8.0, 0.04, 240, 20_000, 60
#: Where a text may change its language.
BREAK = re.compile(r"[.!?]+[\"”’»)]*\s+|[。！？]+[”」』）]*\s*|\s*[\r\n]+\s*|\s+[/|–—]+\s+|\s*[()（）]\s*|\s+-{2,}\s+")
DIGITS = re.compile(r"\d+")
MARKS, SIGNS = re.compile("[\u0300-\u036f]+"), re.compile(r"[\W\d_]+")
NUMBERS = re.compile(r"[$€£]?\d[\d.,]*")
#: Signs that don't count as part of a segment at its ends.
EDGES = " \t\r\n\xa0\u3000/|–—-()（）[]\"'"


def units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the units of a text; together they are the text, white space at the ends apart."""

    def chopped(a: int, b: int) -> Iterator[tuple[int, int]]:
        while b - a > LONG_UNIT:
            cut = text.rfind(" ", a + LONG_UNIT // 2, a + LONG_UNIT)
            cut = cut + 1 if cut > 0 else a + LONG_UNIT
            yield a, cut
            a = cut
        if a < b:
            yield a, b

    a = 0
    for m in BREAK.finditer(text):
        if m.end() > a:
            yield from chopped(a, m.end())
            a = m.end()
    yield from chopped(a, len(text))


def plain(text: str) -> str:
    """Lower case, without accents (many texts lack them), runs of digits as one."""
    text = DIGITS.sub("0", text.lower()).strip()
    if text.isascii():
        return text
    return MARKS.sub("", unicodedata.normalize("NFD", text)).replace("đ", "d")


def wordy(text: str) -> bool:
    """Whether at least half of the signs of a text are letters, a number counting as one sign."""
    text = NUMBERS.sub("0", text)
    text = "".join(text.split())
    letters = len(SIGNS.sub("", text))
    return letters > 0 and 2 * letters >= len(text)


class Classifier:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 3):
        self.dictionaries, self.level = dictionaries, level
        self.langs = sorted(dictionaries)
        self._tools: list | None = None
        self._known: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_tools": None, "_known": {}}

    def sizes(self, text: str) -> np.ndarray:
        known = self._known.get(text)
        if known is not None:
            return known
        if self._tools is None:
            import zstandard as z

            self._tools = []
            for lang in self.langs:
                d = z.ZstdCompressionDict(self.dictionaries[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._tools.append(z.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        raw = text.encode("utf-8", "replace")
        out = np.array([len(tool(raw)) for tool in self._tools], float)
        if len(self._known) < CACHE:
            self._known[text] = out
        return out

    def segments(self, text: str) -> list[tuple[int, int, str | None, float]]:
        """(start, end, language or None, confidence), in order; end and start without white space."""
        cut = list(units(text)) if self.langs else []
        out: list[list] = []
        block: list[tuple[int, int, np.ndarray]] = []

        def flush() -> None:
            if not block:
                return
            cost = np.array([s for _, _, s in block])
            total, back = cost[0].copy(), []
            for row in cost[1:]:
                change = int(total.argmin())
                stay = total <= total[change] + SWITCH
                back.append(np.where(stay, np.arange(len(row)), change))
                total = np.where(stay, total, total[change] + SWITCH) + row
            path = [int(total.argmin())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path.reverse()
            a = 0
            while a < len(path):
                b = a
                while b < len(path) and path[b] == path[a]:
                    b += 1
                both = cost[a:b].sum(axis=0)
                best = both[path[a]]
                rest = np.delete(both, path[a])
                second = rest.min() if len(rest) else best * 2
                sure = second > 0 and second - best >= NARROW * best
                out.append([block[a][0], block[b - 1][1], self.langs[path[a]] if sure else None, float(max(0.0, 1 - best / second)) if second else 0.0])
                a = b
            block.clear()

        for a, b in cut:
            part = text[a:b]
            if not part.strip():
                continue
            if not wordy(part):
                if len(DIGITS.sub("", part.strip())) > 3 or "|" in part or "\t" in part:
                    flush()
                continue
            block.append((a, b, self.sizes(plain(part))))
        flush()
        done: list[tuple[int, int, str | None, float]] = []
        for a, b, lang, sure in out:
            part = text[a:b]
            done.append((a + len(part) - len(part.lstrip(EDGES)), a + len(part.rstrip(EDGES)), lang, sure))
        return done


def train(samples: DataFrame, documents: DataFrame, aliases: DataFrame, per_language: int = PER_LANGUAGE) -> Classifier:
    """Dictionaries of the samples and of a bounded sample of labelled documents."""
    base: dict[str, str] = {}
    for r in sorted(small(samples.select("lang", "text").dropna(), 10_000)):
        base[r[0]] = base.get(r[0], "") + plain(r[1]) + "\n"
    first = Classifier({k: v.encode()[-DICTIONARY:] for k, v in base.items()})
    known = documents.select("doc_id", "lang", "text").join(resolved(aliases), F.lower(F.trim("lang")) == F.col("label_form")).where(F.length("text").between(1, SAMPLE_CHARS))
    best = F.min_by(F.struct("doc_id", "text"), F.xxhash64("doc_id"))
    # One document per (language, hash class) is a combinable aggregate, and per_language classes bound the sample.
    few = known.groupBy("known_lang", F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(per_language)).alias("k")).agg(best.alias("d"))
    texts = [(r[0], r[1]) for r in few.select("known_lang", "d.text", "d.doc_id").orderBy("known_lang", "doc_id").collect() if r[0] in base]
    again = _trained(first, base, texts)
    return _trained(again, base, texts)


def _trained(judge: Classifier, base: dict[str, str], texts: list[tuple[str, str]]) -> Classifier:
    """Dictionaries of the samples and of the units of the texts whose label the judge confirms."""
    votes: dict[str, Counter] = {}
    for lang, text in texts:
        stretches = judge.segments(text)
        chars = Counter()
        for a, b, g, _ in stretches:
            chars[g] += b - a
        if not chars or chars.most_common(1)[0][0] != lang:
            continue  # the text speaks against the label
        foreign = [(a, b) for a, b, g, _ in stretches if g != lang and b - a >= FOREIGN]
        for a, b in units(text):
            if wordy(text[a:b]) and not any(x < b and a < y for x, y in foreign):
                votes.setdefault(plain(text[a:b]), Counter())[lang] += 1
    more: dict[str, list[str]] = {}
    for unit, langs in votes.items():  # a unit goes to the language most of whose texts have it
        more.setdefault(langs.most_common(1)[0][0], []).append(unit)
    out = {}
    for lang, sample in base.items():
        tail = sample.encode()[-DICTIONARY:]
        room = DICTIONARY - len(tail)
        out[lang] = ("\n".join(more.get(lang, [])) + "\n").encode()[-room:] * (room > 0) + tail
    return Classifier(out)


def resolved(aliases: DataFrame) -> DataFrame:
    """(label_form, known_lang), one row per form."""
    return aliases.groupBy("label_form").agg(F.min("lang").alias("known_lang"))


SEGMENTS = "array<struct<start:int,end:int,lang:string,confidence:double>>"


def label(documents: DataFrame, text: str, classifier: Classifier) -> DataFrame:
    """Adds ``segments``: the stretches of each document with their language and confidence."""

    kind = arrow_type(SEGMENTS)

    @F.arrow_udf(SEGMENTS)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[dict(zip(("start", "end", "lang", "confidence"), s)) for s in classifier.segments(t)] if t else [] for t in texts.to_pylist()], kind)

    # Not to be repeated by the optimizer for a filter on its result.
    return spread(documents).withColumn("segments", of.asNondeterministic()(F.col(text)))


def present(labelled: DataFrame, run_min: int) -> DataFrame:
    """Adds ``found``: the languages of segments of at least run_min characters, sorted."""
    long = F.filter("segments", lambda s: (s["end"] - s["start"] >= run_min) & s["lang"].isNotNull())
    return labelled.withColumn("found", F.array_sort(F.array_distinct(F.transform(long, lambda s: s["lang"]))))


def wrong_labels(labelled: DataFrame, aliases: DataFrame, run_min: int) -> DataFrame:
    """(doc_id, found_lang): documents whose label is unknown, stands for no language present, or that hold several."""
    forms = small(resolved(aliases), MAX_FORMS)
    table = aliases.sparkSession.createDataFrame([(r[0], r[1]) for r in forms], "_form string, known string")
    trimmed = F.lower(F.regexp_replace("lang", f"^{SPACE}+|{SPACE}+$", ""))
    rows = present(labelled.select("doc_id", trimmed.alias("_form"), "segments"), run_min).join(F.broadcast(table), "_form", "left")  # at most MAX_FORMS rows
    case = (F.size("found") > 1) | F.col("known").isNull() | ~F.array_contains("found", F.col("known"))
    return rows.where((F.size("found") > 0) & case).select("doc_id", F.explode("found").alias("found_lang"))


def document_labels(labelled: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence): the language with most characters, and its share weighted by the margins."""
    total = F.aggregate("segments", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    one = labelled.select("doc_id", "segments", total.alias("total"))
    langs = F.array_distinct(F.transform("segments", lambda s: s["lang"]))
    per = F.transform(
        F.filter(langs, lambda g: g.isNotNull()),
        lambda g: F.struct(
            F.aggregate(F.filter("segments", lambda s: s["lang"] == g), F.lit(0), lambda acc, s: acc + s["end"] - s["start"]).alias("chars"),
            F.aggregate(F.filter("segments", lambda s: s["lang"] == g), F.lit(0.0), lambda acc, s: acc + s["confidence"] * (s["end"] - s["start"])).alias("weight"),
            g.alias("lang"),
        ),
    )
    top = one.withColumn("top", F.array_max(per))
    return top.select("doc_id", F.col("top.lang").alias("found_lang"), F.when(F.col("total") > 0, F.col("top.weight") / F.col("total")).alias("confidence"))
