"""Summaries on small tables: levels built from each other, concepts, sections."""
from pyspark.sql import functions as F

from recollect.operators import summaries as S

M = "key string, value string, kind string, w string, sentence string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], M).repartition(3)


COMMON = "the common sentence stands everywhere in here"


def test_levels_read_what_the_level_below_kept(spark):
    rows = [(f"k{i}", f"{COMMON}. unique{i} words{i} number{i} only. {COMMON}! plain words stand everywhere in here", "odd" if i % 2 else "even") for i in range(6)]
    rows += [("short", "Too short.", "odd"), ("none", None, "odd"), ("lost", "a sentence of the memory without any kind", None), ("long", "x" * 300, "even")]
    got = S.summary_tree(made(spark, rows), [("memory", F.col("key")), ("kind", F.col("kind")), ("all", F.lit("all"))], keep=1).collect()
    by = {(r.level, r.node): r for r in got}
    assert {n for level, n in by if level == "memory"} == {*(f"k{i}" for i in range(6)), "lost"}
    assert by["memory", "k3"].sentence == "unique3 words3 number3 only" and by["memory", "k3"].parent == "odd" and by["memory", "lost"].parent == "none"
    assert {n for level, n in by if level == "kind"} == {"odd", "even", "none"} and by["kind", "odd"].parent == "all"
    below = {level: {r.sentence for r in got if r.level == level} for level in ("memory", "kind", "all")}
    assert below["all"] <= below["kind"] <= below["memory"] and len(below["all"]) == 1 and by["all", "all"].parent is None
    assert all(r["rank"] == 1 for r in got)
    assert S.summary_tree(made(spark, rows).limit(0), [("memory", F.col("key")), ("all", F.lit("all"))]).collect() == []


def test_terms_that_go_together_are_one_concept(spark):
    rows = [(f"a{i}", "engine piston " + "filler" * (i + 1), "x") for i in range(3)] + [(f"b{i}", f"piston valve {'padding' * (i + 1)}", "x") for i in range(3)] + [(f"c{i}", "flower petal", "x") for i in range(3)] + [("d", "", "x"), ("e", None, "x"), ("f", "lonely", "x"), ("g", "lonely", "x")]
    got = {r.term: r.concept for r in S.concepts(made(spark, rows)).collect()}
    assert got == {"engine": "engine", "piston": "engine", "valve": "engine", "flower": "flower", "petal": "flower", "lonely": "lonely"}
    groups = {r.concept: (r.n_terms, r.n_memories, r.lead) for r in S.concept_summary(made(spark, rows)).collect()}
    assert groups == {"engine": (3, 6, "engine piston filler..."), "flower": (2, 3, "flower petal..."), "lonely": (1, 2, "lonely...")}
    assert S.concepts(made(spark, rows).limit(0)).collect() == []


def test_places_in_sections_go_on_over_ranges(spark):
    lines = spark.range(0, 500).select(F.when(F.col("id") < 450, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("part"), F.col("id").alias("at")).repartition(7)
    got = {}
    for r in S.sections(lines, "part", "at").collect():
        got.setdefault(r.section, []).append((r.pos, r.at))
    assert {s: [p for p, _ in sorted(v)] for s, v in got.items()} == {s: list(range(1, len(v) + 1)) for s, v in got.items()}
    assert all([a for _, a in sorted(v)] == sorted(a for _, a in v) for v in got.values()) and len(got["hot"]) == 450


def test_words_do_not_carry_their_sentences(spark):
    from recollect.operators.management import key_points
    from recollect.operators.summaries import telling_sentences

    m = spark.createDataFrame([("a", "A first sentence of fitting length. A second sentence of fitting length."), ("b", "Short one here. A first sentence of fitting length.")], "key string, value string")
    s = m.selectExpr("key AS node", "explode(split(value, '[.] ?')) AS sentence")
    for found in (key_points(m), telling_sentences(s, 2)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.splitlines() if "Aggregate" in x and "sentence" in x.split("Aggregate", 1)[1]]
        assert found.count() == 3
