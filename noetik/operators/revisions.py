"""Line differences between versions: shortest edit scripts, and what they make of the older version."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

HUNK = pa.struct([("at", pa.int64()), ("gone", pa.int64()), ("lines", pa.list_(pa.string()))])
HUNK_SQL = "struct<at: long, gone: long, lines: array<string>>"


def _step(reach: dict[int, int], k: int, n: int, m: int) -> tuple[int, int] | None:
    """Where one more edit leads on diagonal k, and the diagonal it comes from: a line of the new version (from k + 1) or
    one less of the old (from k - 1), whichever reaches further; the latter in a tie."""
    down = reach.get(k + 1)
    down = None if down is None or down - k > m else down
    right = reach.get(k - 1)
    right = None if right is None or right + 1 > n else right + 1
    if right is not None and (down is None or right >= down):
        return right, k - 1
    return None if down is None else (down, k + 1)


def matched(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists, as pairs of places, by Myers' greedy search: the furthest place on each
    diagonal (place in a less place in b) after 0, 1, 2, ... edits, until the end is reached; then back along the way."""
    n, m = len(a), len(b)

    def slide(x: int, k: int) -> int:
        while x < n and x - k < m and a[x] == b[x - k]:
            x += 1
        return x

    trace = [{0: slide(0, 0)}]
    while trace[-1].get(n - m, -1) < n:
        last, now = trace[-1], {}
        for k in range(max(-m, -len(trace)), min(n, len(trace)) + 1):
            if step := _step(last, k, n, m):
                now[k] = slide(step[0], k)
        trace.append(now)
    out, x, k = [], n, n - m
    for last in reversed([None, *trace[:-1]]):
        begin, before = _step(last, k, n, m) if last is not None else (0, 0)
        out += [(i, i - k) for i in range(x - 1, begin - 1, -1)]
        if last is not None:
            x, k = last[before], before
    return out[::-1]


def script(old: list[str], new: list[str]) -> tuple[list[dict], int]:
    """Hunks (place in the old version, lines that go, lines that come) in order, and the number of lines that stay.
    Lines that one version has alone are never kept, so only the others are searched."""
    both = set(old) & set(new)
    a, b = [i for i, x in enumerate(old) if x in both], [j for j, x in enumerate(new) if x in both]
    head = 0
    while head < min(len(a), len(b)) and old[a[head]] == new[b[head]]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and old[a[-1 - tail]] == new[b[-1 - tail]]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    kept = list(zip(a[:head], b[:head], strict=True))
    kept += [(mid_a[i], mid_b[j]) for i, j in matched([old[i] for i in mid_a], [new[j] for j in mid_b])]
    kept += list(zip(a[len(a) - tail :], b[len(b) - tail :], strict=True))
    out, i, j = [], 0, 0
    for x, y in [*kept, (len(old), len(new))]:
        if x > i or y > j:
            out.append({"at": i, "gone": x - i, "lines": new[j:y]})
        i, j = x + 1, y + 1
    return out, len(kept)


def differences(pairs: DataFrame, keys: list[str], old: str = "old", new: str = "new") -> DataFrame:
    """keys, inserted, deleted, kept (lines) and hunks of each row's two texts. A null text has no lines; an empty one
    has one, which is empty. Lines end at \\n alone."""
    ship(pairs.sparkSession)
    pairs = pairs.select(*keys, F.col(old).alias("old"), F.col(new).alias("new"))

    def run(batches):
        for b in batches:
            lines = [[[] if t is None else t.split("\n") for t in b.column(c).to_pylist()] for c in ("old", "new")]
            found = [script(x, y) for x, y in zip(*lines, strict=True)]
            count = lambda side: pa.array([len(x) - k for x, (_, k) in zip(lines[side], found, strict=True)], pa.int64())
            out = [*(b.column(k) for k in range(len(keys))), count(1), count(0), pa.array([k for _, k in found], pa.int64()), pa.array([h for h, _ in found], pa.list_(HUNK))]
            yield pa.RecordBatch.from_arrays(out, [*keys, "inserted", "deleted", "kept", "hunks"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema if f.name in keys)
    return pairs.mapInArrow(run, f"{kinds}, inserted long, deleted long, kept long, hunks array<{HUNK_SQL}>")


def applied(old: Column, hunks: Column) -> Column:
    """The newer text, from the older one and the hunks: what stands between two hunks, and what each brings."""
    lines = F.coalesce(F.split(old, "\n", -1), F.array().cast("array<string>"))
    size = F.size(lines).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, h):
        between = F.slice(lines, (s["at"] + 1).cast("int"), (h["at"] - s["at"]).cast("int"))
        return F.struct((h["at"] + h["gone"]).alias("at"), F.concat(s["out"], between, h["lines"]).alias("out"))

    last = F.struct(size.alias("at"), F.lit(0).cast("long").alias("gone"), F.array().cast("array<string>").alias("lines"))
    every = F.aggregate(F.concat(hunks, F.array(last)), start, step, lambda s: s["out"])
    return F.when(F.size(every) > 0, F.array_join(every, "\n"))
