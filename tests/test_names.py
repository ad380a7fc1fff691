"""Like names and mentions against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from noetik.operators import edit_distance, evidence, mentions


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def pairs(spark, left, right, distance):
    table = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    rows = edit_distance.near_strings(table(left), table(right), distance).collect()
    assert len({(r.a, r.b) for r in rows}) == len(rows)
    return {(r.a, r.b): r.distance for r in rows}


def brute(left, right, distance):
    every = {(a, b): levenshtein(a, b) for a in left for b in right if a is not None and b is not None}
    return {p: n for p, n in every.items() if n <= distance}


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_near_strings(spark, distance):
    rng = random.Random(distance)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(12)))
    left, right = [word() for _ in range(150)] + [None, ""], [word() for _ in range(150)] + [None, "", "é日本", "é日"]
    assert pairs(spark, left, right, distance) == brute(left, right, distance)


def test_short_names_are_exact(spark):
    names = ["", "a", "b", "ab", "cd", "abc", "xyz", "abcd", "wxyz", "abcde"]
    assert pairs(spark, names, names, 2) == brute(names, names, 2)


def test_names_with_a_common_begin(spark, monkeypatch):
    monkeypatch.setattr(edit_distance, "HOT", 5)
    names = [f"Supplier#{k:06d}" for k in range(0, 3000, 23)] + ["Supplier#", "supplier#000023", "Supplier#0000x"]
    assert pairs(spark, names, names, 2) == brute(names, names, 2)


def test_classes_of_equal_names(spark):
    df = spark.createDataFrame([(5, "ring"), (2, "ring"), (9, "rings"), (1, None), (3, "bolt"), (4, "bold"), (7, "")], "id int, name string")
    assert {tuple(r) for r in edit_distance.near_names(df, 1).collect()} == {(2, 9, 2, 1, 1), (3, 4, 1, 1, 1)}


def test_short_mentions_are_candidates(spark):
    said = spark.createDataFrame([(1, "cd", "tool", 1), (2, "ab", "tool", 1), (3, "qqqq", "tool", 1), (4, "cd", "place", 1)], "mention_id int, mention_text string, type_hint string, truth int")
    known = spark.createDataFrame([(1, "tool", "ab", None)], "entity_id int, entity_type string, name string, merged_into int")
    got = evidence.resolve(said, known, known.limit(0).select("entity_id", F.col("name").alias("alias")))
    assert {r.mention_id: (r.entity_id, r.band) for r in got.collect()} == {1: (1, "candidate"), 2: (1, "auto"), 3: (None, "provisional"), 4: (None, "provisional")}


def spans(texts, names):
    """Every place of a name with no letter or digit beside it, without those inside a longer one."""
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    out = set()
    for k, text in texts.items():
        t, own = fold(text or ""), set()
        for n in {fold(n) for n in names if n}:
            i = t.find(n)
            while i >= 0:
                if not (i and t[i - 1].isalnum()) and not (i + len(n) < len(t) and t[i + len(n)].isalnum()):
                    own.add((i, i + len(n)))
                i = t.find(n, i + 1)
        out |= {(k, i, j, t[i:j]) for i, j in own if not any((a, b) != (i, j) and a <= i and j <= b for a, b in own)}
    return out


@pytest.mark.parametrize("most", [12, 1_000_000])
def test_mentions(spark, monkeypatch, most):
    monkeypatch.setattr(mentions, "MOST_CHARACTERS", most)
    names = ["Red Ring", "ring", "red ring of fire", "ring of", "é", "İstanbul kit", "a", "", None, "C++", "日本", "ring"]
    texts = {1: "A red ring, a RING of fire and a red ring of fire.", 2: None, 3: "", 4: "bring rings ring", 5: "é éa C++ c++x 日本 日本語", 6: "İstanbul kit is a kit", 7: "ring " * 500, 8: "red ring of of"}
    rng = random.Random(2)
    texts |= {k: " ".join(rng.choices(["red", "ring", "of", "fire", "a", "b,"], k=30)) for k in range(10, 40)}
    table = spark.createDataFrame([(k, t, 0) for k, t in texts.items()], "id int, text string, name int")
    got = mentions.mentions(table, spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {tuple(r) for r in got} == spans(texts, names) and len(got) == len(spans(texts, names))
    assert mentions.mentions(table, spark.createDataFrame([(None,), ("",)], "name string")).collect() == []
    assert mentions.mentions(table.limit(0), spark.createDataFrame([("a",)], "name string")).collect() == []


def test_mentions_meet_all_entities_of_a_name(spark):
    found = mentions.mentions(spark.createDataFrame([(1, "the red ring")], "id int, text string"), spark.createDataFrame([("Red ring",)], "name string"))
    known = spark.createDataFrame([("part", 7, "red ring"), ("part", 3, "Red Ring"), ("tool", 9, "RED RING"), ("part", 1, "bolt")], "kind string, entity_id int, name string")
    assert {(r.start, r.end, r.kind, r.entity_id, r.n_entities) for r in mentions.linked(found, known).collect()} == {(4, 12, "part", 3, 2), (4, 12, "tool", 9, 1)}


def test_profiles_leave_unknown_fields_null(spark):
    texts = [(1, "The tool AgentKit at https://kit.example/x costs $12.50, limited to small teams."), (2, "nothing is said"), (3, None), (4, "at $5 the app Zip")]
    got = mentions.profile(spark.createDataFrame(texts, "id int, text string"), F.col("text"), mentions.PROFILES["tool_review"]).collect()
    assert {r.id: (r["name"], r.url, r.price, r.limitation) for r in got} == {1: ("AgentKit", "https://kit.example/x", 12.5, "small teams"), 2: (None,) * 4, 3: (None,) * 4, 4: ("Zip", None, 5.0, None)}
    guide = mentions.profile(spark.createDataFrame([(1, "wait 20 min, €9 on 2024-13-40")], "id int, text string"), F.col("text"), mentions.PROFILES["restaurant_guide"]).first()
    assert (guide.wait_minutes, guide.currency, guide.date, guide.price) == (20, "€", None, None)
