"""Mentions of known names in texts, and what is said of them.

Names are compiled into an automaton that meets all of them in one pass over a text. A name counts where no letter or
digit stands beside it; A-Z and a-z are alike. Of spans inside one another the longest stays. A dictionary of at most
MOST_CHARACTERS goes to every task. Of a larger one each block of texts gets the names whose rarest word it holds: no
letter or digit stands beside a name, so each word of it is a whole word of the text. The automaton of a block takes
MOST_CHARACTERS of them at a time.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..llm import blocks as B
from ..session import cut, ship

MOST_CHARACTERS = 4_000_000
WORD = re.compile(r"[^\W_]+")  # the runs of what str.isalnum takes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """Lower-case A-Z and nothing else, so that places stay what they are."""
    return F.translate(text, UPPER, LOWER)


def outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie inside no other."""
    out, reached = [], -1
    for begin, end in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > reached:
            out.append((begin, end))
            reached = end
    return out


def _known(names: DataFrame) -> tuple[DataFrame, int]:
    """Distinct names (name) without empty ones, and their characters."""
    known = names.where("name <> ''").select("name").distinct()
    return known, known.agg(F.sum(F.length("name"))).first()[0] or 0


def _parts(names: DataFrame) -> list[list[str]]:
    """Distinct names (name) in parts of at most about MOST_CHARACTERS, without empty ones."""
    known, n = _known(names)
    parts = max(1, -(-n // MOST_CHARACTERS))
    part = F.pmod(F.xxhash64("name"), F.lit(parts))
    each = [[r.name for r in known.where(part == k).collect()] for k in range(parts)]  # bounded parts of a dictionary
    return [some for some in each if some]


def _automaton(names: list[str]):
    import ahocorasick

    known = ahocorasick.Automaton()
    for n in names:
        known.add_word(n, len(n))
    known.make_automaton()
    return known


def _standing(known, text: str) -> list[tuple[int, int]]:
    """Places of known names with no letter or digit beside them."""
    spans = ((last + 1 - size, last + 1) for last, size in known.iter(text))
    return [(i, j) for i, j in spans if not (i and text[i - 1].isalnum()) and not (j < len(text) and text[j].isalnum())]


def _keyed(names: DataFrame) -> DataFrame:
    """name, unit: of each distinct name (name) its word that the fewest names have, or such a character if it has no word."""

    def run(batches):
        for b in batches:
            own, units = [], []
            for n in b.column(0).to_pylist():
                found = set(WORD.findall(n)) or set(n)
                own += [n] * len(found)
                units += found
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(units, pa.string())], ["name", "unit"])

    each = cut(names.select("name").mapInArrow(run, "name string, unit string"))  # read twice
    return each.join(each.groupBy("unit").agg(F.count("*").alias("n")), "unit").groupBy("name").agg(F.min_by("unit", F.struct("n", "unit")).alias("unit"))


def _in_blocks(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, start, end, name of the outermost whole mentions of many distinct names. Texts and names are read once."""
    stored = B.stored(texts.where("text <> ''").select("id", "text"))
    keyed = cut(_keyed(names))
    signs = not keyed.where(F.length("unit") == 1).isEmpty()  # only such units may be no words
    kind, most = texts.schema["id"].dataType.simpleString(), MOST_CHARACTERS

    def units(batches):
        for b in batches:
            for block, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set()
                for text in B.rows_of(data).column("text").to_pylist():
                    found.update(WORD.findall(text))
                    if signs:
                        found.update(text)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(list(found), pa.string())], ["block", "unit"])

    def scan(of: pa.Table, met: pa.Table) -> pa.Table:
        rows = B.rows_of(of.column("data")[0].as_py())
        texts, spans = rows.column("text").to_pylist(), {}
        begin, known = 0, met.column("name").to_pylist()
        while begin < len(known):
            end, n = begin, 0
            while end < len(known) and n < most:
                n += len(known[end])
                end += 1
            automaton = _automaton(known[begin:end])
            for k, text in enumerate(texts):
                if found := _standing(automaton, text):
                    spans.setdefault(k, []).extend(found)
            begin = end
        places = [(k, i, j) for k, own in spans.items() for i, j in outermost(own)]
        at, begins, ends = zip(*places, strict=True) if places else ((), (), ())
        said = pa.array([texts[k][i:j] for k, i, j in places], pa.string())
        return pa.table([rows.column("id").take(pa.array(at, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), said], ["id", "start", "end", "name"])

    met = stored.mapInArrow(units, "block long, unit string").join(keyed, "unit").select("block", "name")
    return stored.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(scan, f"id {kind}, start long, end long, name string")


def _scan(texts: DataFrame, names: list[str], whole: bool) -> DataFrame:
    """id, start, end, name of the outermost whole mentions; or, of names anywhere, each once for a text."""
    shared = texts.sparkSession.sparkContext.broadcast(names)  # MOST_CHARACTERS at most
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches):
        known = _automaton(shared.value)
        for b in batches:
            ids, begins, ends, said = [], [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                if whole:
                    found = outermost(_standing(known, text or ""))
                else:
                    found = {text[last + 1 - size : last + 1]: (last + 1 - size, last + 1) for last, size in known.iter(text or "")}.values()
                for i, j in found:
                    ids.append(k)
                    begins.append(i)
                    ends.append(j)
                    said.append(text[i:j])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(begins, pa.int64()), pa.array(ends, pa.int64()), pa.array(said, pa.string())], ["id", "start", "end", "name"])

    return texts.mapInArrow(run, f"id {kind}, start long, end long, name string")


def holding(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, name of each text (id, text) and each name (name) that stands anywhere in it; both as they are given."""
    scans = [_scan(texts.select("id", "text"), some, False).select("id", "name") for some in _parts(names)]
    return reduce(lambda a, b: a.unionByName(b), scans) if scans else texts.limit(0).select("id", F.lit("").alias("name"))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """id, start, end, name of each place of texts (id, text) where a name (name) stands; places count characters from 0,
    the end is outside. Null and empty texts and names meet nothing."""
    ship(texts.sparkSession)
    texts = texts.select("id", folded(F.col("text")).alias("text"))
    known, n = _known(names.select(folded(F.col("name")).alias("name")))
    if n > MOST_CHARACTERS:
        return _in_blocks(texts, known)
    some = [r.name for r in known.collect()]  # MOST_CHARACTERS at most
    if not some:
        return texts.limit(0).select("id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit("").alias("name"))
    return _scan(texts, some, True)


def linked(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions with the entities of their name: kind, entity_id (the smallest) and n_entities. entities: kind, entity_id, name."""
    of = entities.groupBy(folded(F.col("name")).alias("name"), "kind").agg(F.min("entity_id").alias("entity_id"), F.count("*").alias("n_entities"))
    return found.join(of, "name")


#: Profiles: fields of a kind of source, each with the pattern whose first group is its value, and its type.
PROFILES = {
    "tool_review": {"name": (r"(?:tool|app) ([A-Za-z][A-Za-z0-9]+)", "string"), "url": (r"(https?://[A-Za-z0-9./_-]+)", "string"), "price": (r"\$([0-9]+(?:\.[0-9]+)?)", "double"), "limitation": (r"(?:limited to|only for) ([a-z ]+)", "string")},
    "restaurant_guide": {"price": (r"\$([0-9]+(?:\.[0-9]+)?)", "double"), "currency": (r"([$€])[0-9]", "string"), "wait_minutes": (r"wait (?:of )?([0-9]+) min", "int"), "date": (r"([0-9]{4}-[0-9]{2}-[0-9]{2})", "date")},
}


def profile(evidence: DataFrame, text: Column, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """evidence with a typed column for each field; a field of which the text is silent, or whose value is not of its
    type, is null, and nothing is made up."""
    value = lambda p: F.when(text.rlike(p), F.regexp_extract(text, p, 1))
    return evidence.select("*", *(value(p).try_cast(kind).alias(name) for name, (p, kind) in fields.items()))
