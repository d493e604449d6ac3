from pyspark.sql import functions as F

from lexspan.functions import text as tx
from lexspan.operators import compare, walk


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_reference_targets(spark):
    rows = {"Articles 8 to 11 and 15": "art_8 art_9 art_10 art_11 art_15", "Article 6(3)": "art_6.3 art_6", "Schedules I to III": "sch_I sch_III", "Articles 5a to 5c": "art_5a art_5b art_5c", "Articles 5 to 3b, 4": "art_5 art_3b art_4"}
    frame = spark.createDataFrame([(k,) for k in rows], "p string")
    assert {r.p: " ".join(r.t) for r in frame.select("p", walk.targets_of(F.col("p")).alias("t")).collect()} == rows


def test_references_to_other_acts_are_dropped(spark):
    rows = spark.createDataFrame([("art_1", "See Articles 2 and 3 of Directive 9, and Article 4 of this act."), ("art_2", ""), ("art_3", ""), ("art_4", "As Article 4(1) says.")], "id string, text string")
    got = {(r.source_id, r.target_id) for r in walk.extract_references(rows).collect()}
    assert got == {("art_1", "art_4")}


def test_citations(spark):
    assert one(spark, tx.citation_to_id(F.lit("schedule iv"))) == "sch_IV"
    assert one(spark, tx.citation_to_id(F.lit("Article 5(2)"))) == "art_5.2"
    assert one(spark, tx.citation_to_id(F.lit("Title 5"))) is None


def test_normalize_and_thinking(spark):
    assert one(spark, tx.normalize(F.lit(" ﬁne  text "))) == "fine text"
    assert one(spark, tx.split_thinking(F.lit("<think>a\nb</think> yes <think>open"))) == "yes"


def test_pack_points_keeps_long_points_whole(spark):
    text = "Intro: (1) aaaa (2) bbbb (3) cccccccccccccccccccc"
    assert one(spark, tx.pack_points(F.lit(text), budget=18)) == ["Intro: (1) aaaa", "(2) bbbb", "(3) cccccccccccccccccccc"]
    assert one(spark, tx.pack_points(F.lit("no points"))) == ["no points"]


def test_word_diff():
    before, after = compare.diff("the old rule", "the new rule")
    assert [s["text"] for s in before if s["changed"]] == ["old"]
    assert [s["text"] for s in after if s["changed"]] == ["new"]


def test_walk_order_and_cap(spark):
    seeds = spark.createDataFrame([(1, "s", 1)], "query_id long, id string, pos int")
    edges = spark.createDataFrame([("s", "art_8", 1), ("s", "art_10", 2), ("art_8", "z", 1), ("art_10", "z", 1), ("z", "s", 1)], "source_id string, target_id string, ord long")
    got = [(r.id, r.hop, r.src) for r in walk.walk(seeds, edges, 2, 2).orderBy("rank").collect()]
    assert got == [("art_10", 1, "s"), ("art_8", 1, "s")]
    full = {r.id: r.src for r in walk.walk(seeds, edges, 3, None).collect()}
    assert full == {"art_8": "s", "art_10": "s", "z": "art_8"}


def test_references_equal_a_plain_reading(spark):
    import random
    import re

    def between(a, b):
        if a.isdigit() and b.isdigit():
            return [str(n) for n in range(int(a) + 1, int(b))]
        if a[:-1] == b[:-1] and a[-1].isalpha() and b[-1].isalpha():
            return [a[:-1] + chr(c) for c in range(ord(a[-1]) + 1, ord(b[-1]))]
        return []

    def plain(text):
        out = []
        for m in re.finditer(walk.reference_pattern(), text):
            if m[2]:
                continue
            if not m[1].startswith("Article"):
                out += [(f"sch_{n}", m[1]) for n in re.findall(r"\b[IVXLC]+\b", m[1].split(None, 1)[1])]
                continue
            part, named, to = re.search(r"\(\s*(\d+[a-z]?)\s*\)", m[1]), [], False
            for w in re.findall(r"\d+[a-z]?|\bto\b", re.sub(r"\([^)]*\)", "", m[1])):
                if w == "to":
                    to = bool(named)
                    continue
                named += [*(between(named[-1], w) if to else ()), w]
                to = False
            ids = [f"art_{n}" for n in named]
            out += [(x, m[1]) for x in ([f"{ids[0]}.{part[1]}", ids[0]] if part and len(ids) == 1 else ids)]
        return out

    rng = random.Random(4)
    bits = ["Article ", "Articles ", "Schedule ", "Schedules ", "3", "7", "12", "3a", "3c", "(2)", "( 4b )", " to ", " and ", ", ", "IV", "II", " of Directive 5", ", and of the Regulation", " say ", "é", "\u00a0", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(2, 14))) for _ in range(1_500)] + ["", None]
    got: dict = {}
    for r in walk.references(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).orderBy("source_id", "ord").collect():
        got.setdefault(r.source_id, []).append((r.target_id, r.phrase))
    for n, t in enumerate(texts):
        assert got.get(n, []) == plain(t or ""), t
