"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from latticework.llm import decontamination, html_templates, language_id, lm_scoring, mixing, preference, quality_rules, simhash, suffix_dedup, token_counts
from latticework.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = ["rep", "h0", "h1", "row", "k0", "k1", "spans", "key", "body", "node", "label", "marks", "kept", "keep", "part", "upto", "epoch", "good", "n", "uid", "item_id", "text_key", "count"]
PROSE = "The quiet river bends around an old mill where nobody has worked since spring. "


def long_text():
    return " ".join(f"word{i % 977}x{i}" for i in range(60_000)) + "."


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and symbol texts, a long text, repeated rows, and the same text under two ids."""
    rows = [
        (1, PROSE * 3, "en", "a", 10),
        (1, PROSE * 3, "en", "a", 10),
        (2, PROSE * 3, "en", "b", 10),
        (3, None, "en", "a", None),
        (4, "", "en", None, 0),
        (5, "?! ...", None, "b", 6),
        (6, long_text(), "en", "a", 1),
        (None, "A row without an id says something of its own here.", "en", "b", 3),
        (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def clashing(odd):
    return odd.select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "Which lantern did the ferryman hang above the seventh gate? He hung the copper lantern."), (2, None), (None, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def per_document(spark, docs, benchmark, labels):
    return {
        "quality": quality_rules.judge(docs),
        "scores": lm_scoring.score(docs, labels),
        "tokens": token_counts.count(docs, vocabulary()),
    }


def test_one_row_for_each_row(spark, odd, clashing, benchmark, labels):
    for docs in (odd, clashing):
        for name, d in per_document(spark, docs, benchmark, labels).items():
            ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in d.select("doc_id").collect())
            assert ids == [-1, -1, 1, 1, 2, 3, 4, 5, 6], name


def test_empty_tables(spark, empty, benchmark, labels):
    none = spark.createDataFrame([], benchmark.schema)
    no_labels = spark.createDataFrame([], labels.schema)
    for d in (*per_document(spark, empty, benchmark, no_labels).values(), language_id.spans(empty), simhash.removed(empty), simhash.apply(empty), suffix_dedup.repeats(empty), suffix_dedup.apply(empty), mixing.plan(empty), quality_rules.apply(empty)):
        assert d.count() == 0
    full = spark.createDataFrame([(1, PROSE, "en", "a", 1)], SCHEMA)
    assert decontamination.matches(empty, benchmark).count() == 0
    assert decontamination.matches(full, none).count() == 0
    assert decontamination.apply(full, none).count() == 1
    assert decontamination.apply(empty, benchmark).count() == 0
    assert preference.from_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert html_templates.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    # no good document: the target model is uniform
    assert lm_scoring.score(full, no_labels).first().n_tokens == 14


def test_quality(odd, clashing):
    by = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    licence = "This file is licensed under the Some License, version 2.\n" * 50 + "It works well."
    foreign = "Alle Rechte vorbehalten.\nWir verwenden Cookies, um die Seite zu verbessern.\nStartseite\nAnmelden.\nWeiterlesen."
    french = "Tous droits réservés.\nAccueil\nLire la suite\nC'est le texte."
    spanish = "Todos los derechos reservados.\nInicio\nLeer más\nEste es el texto."
    judged = quality_rules.judge(odd.sparkSession.createDataFrame([(1, licence), (2, foreign), (3, french), (4, spanish)], "doc_id long, text string")).collect()
    got = {r.doc_id: r for r in judged}
    assert not any(r.keep for r in judged) and got[1].kept_share < 0.01 and got[2].chars_kept == 0
    assert (got[3].n_boilerplate, got[3].n_navigation, got[3].clean_text) == (1, 2, "C'est le texte.")
    assert (got[4].n_boilerplate, got[4].n_navigation, got[4].clean_text) == (1, 2, "Este es el texto.")
    assert by[1].keep and by[1].clean_text == PROSE * 3 and by[6].keep
    assert not by[3].keep and by[3].kept_share == 0 and not by[4].keep
    kept = quality_rules.apply(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id or -1 for r in kept.select("doc_id").collect()) == [-1, 1, 1, 2, 5, 6]


def test_simhash(odd, clashing):
    assert [(r.doc_id, r.kept_id) for r in simhash.removed(odd).collect()] == [(2, 1)]
    left = simhash.apply(clashing)
    assert left.columns == clashing.columns
    assert sorted(r.doc_id or -1 for r in left.select("doc_id").collect()) == [-1, -1, 1, 3, 4, 5, 6]


def test_simhash_of_texts_that_share_a_doc_id(spark):
    other = "Seven bridges cross the canal, and the oldest of them carries nothing but a narrow garden path."
    rows = [(1, PROSE * 3, "b"), (1, other, "x"), (1, PROSE * 3, "a"), (2, other, "y"), (3, PROSE * 3, "z"), (3, "Nothing like the others was ever said about lighthouses.", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    assert sorted((r.doc_id, r.kept_id) for r in simhash.removed(docs).collect()) == [(2, 1), (3, 1)]
    left = sorted((r.doc_id, r.text, r.tag) for r in simhash.apply(docs).collect())
    assert left == sorted((r.doc_id, r.text, r.tag) for r in simhash.apply(docs, broadcast_limit=0).collect())
    assert left == sorted([(1, PROSE * 3, "a"), (1, other, "x"), (3, rows[5][1], "w")])


def test_scores_of_nothing(odd, labels):
    by = {r.doc_id: r for r in lm_scoring.score(odd, labels).collect() if r.doc_id}
    assert by[3].n_tokens == by[4].n_tokens == 0 and by[3].loss_target is None and by[4].loss_difference is None
    assert by[6].n_tokens == 60_000
    spread = lm_scoring.score(odd, labels, part_bytes=300, part_rows=2, shards=5).collect()
    assert sorted(map(str, spread)) == sorted(map(str, lm_scoring.score(odd, labels).collect()))


def test_decontamination(odd, clashing, benchmark):
    assert decontamination.matches(odd, benchmark).count() == 0
    left = decontamination.apply(clashing, benchmark)
    assert left.columns == clashing.columns and left.count() == clashing.count()


def test_suffixes(spark, clashing):
    rows = suffix_dedup.repeats(clashing).collect()
    assert rows == []  # 42 words at most are shared, but for repeated rows
    w = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, w, "x"), (1, w, "x"), (2, "Before. " + w + " after", "y"), (3, w, "z"), (None, w, "n"), (4, w + " " + w, "t")], "doc_id long, text string, spans string")
    got = sorted(tuple(r) for r in suffix_dedup.repeats(docs).collect())
    assert got == [(2, 1, 61, 1), (3, 0, 60, 1), (4, 0, 120, 1)] or got == [(2, 1, 61, 1), (3, 0, 60, 1), (4, 0, 60, 1), (4, 60, 120, 1)]
    left = sorted((r.doc_id or -1, r.text, r.spans) for r in suffix_dedup.apply(docs).collect())
    assert left == [(-1, w, "n"), (1, w, "x"), (1, w, "x"), (2, "Before. after", "y")]


def test_mixing(odd, clashing):
    for docs in (odd, clashing):
        for limit in (100_000, 0):
            rows = mixing.plan(docs, {"a": 1, "b": 2}, total=90, broadcast_limit=limit, salts=3).collect()
            taken = {}
            for r in rows:
                taken[r.source] = taken.get(r.source, 0) + r.tokens_taken
            assert taken == {"a": 30, "b": 60}
            assert any(r.epoch > 0 for r in rows if r.source == "b")
    spark = odd.sparkSession
    big = 2**60 + 1
    ids = spark.createDataFrame([(big, "a b", "s"), (None, "c d", "s")], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.plan(ids).collect()} == {big, None}
    # a source of two tokens that has to fill fifty thousand million
    two = spark.createDataFrame([(1, "a b", "tiny"), (2, " c d e\n f ", "more"), (3, "g", "more"), (3, "g", "more")], "doc_id long, text string, source string")
    rows = mixing.plan(two, total=100_000_000_001).collect()
    by = {}
    for r in rows:
        by[r.source] = by.get(r.source, 0) + r.tokens_taken
    assert by == {"tiny": 50_000_000_000, "more": 50_000_000_000} and len(rows) <= 8
    cut = mixing.apply(two.withColumn("epochs", F.lit("x")), {"more": 1}, total=3).collect()
    assert sum(r.tokens_taken for r in cut) == sum(len(r.text.split()) for r in cut) == 3
    assert all(two.filter(F.col("text").contains(r.text)).count() for r in cut)


def test_tokens_and_languages(odd, clashing):
    by = {r.doc_id: r for r in token_counts.count(clashing, vocabulary()).collect() if r.doc_id}
    assert by[3].n_tokens == by[4].n_tokens == 0 and by[3].n_chunks == 1
    enc, _ = token_counts.encoding(vocabulary())
    assert by[6].n_tokens == len(enc.encode_ordinary(long_text())) and by[6].n_chunks > 1
    spans = language_id.spans(clashing).collect()
    assert {r.doc_id for r in spans if r.lang == "und" and r.n_words == 0} == {3, 4, 5, None}
    assert sum(r.n_words for r in spans if r.doc_id == 6) == 60_000


def test_preference(spark):
    c = "conv_id long, turn long, role string, text string, chosen string, all string"
    rows = [(1, 1, "user", "hi", "x", "y"), (1, 1, "user", "hi", "x", "y"), (1, 2, "assistant", None, "x", "y"), (2, 1, None, "alone", "x", "y"), (None, 1, "user", "q", "x", "y"), (3, 1, "assistant", "first", "x", "y"), (3, 2, "assistant", "z" * 100_000, "x", "y")]
    by = {r.conv_id: r for r in preference.from_conversations(spark.createDataFrame(rows, c)).collect()}
    assert set(by) == {1, 3}
    assert by[1].common_turns == 1 and by[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    for r in by.values():
        for side in ("chosen", "rejected"):
            for a, b in zip(r[f"{side}_mask_start"], r[f"{side}_mask_end"]):
                assert r[side][a:b].endswith("<|im_end|>\n")
    assert by[3].chosen[by[3].chosen_mask_start[0] :].startswith("z" * 100_000)
    late = [(5, 1, "user", "one", "x", "y"), (5, None, "user", "zero", "x", "y"), (5, 2, "assistant", "two", "x", "y")]
    assert preference.from_conversations(spark.createDataFrame(late, c)).first().prompt.index("zero") < 20  # a null turn is the first
    one = spark.createDataFrame([(1, [("user", "a")]), (2, [("user", "b")])], "conv_id long, chosen array<struct<role:string,text:string>>")
    two = spark.createDataFrame([(1, [("user", "a")])], "conv_id long, rejected array<struct<role:string,text:string>>")
    got = {r.conv_id: r for r in preference.pairs(one, two).collect()}
    assert (got[1].common_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert got[2].common_turns == 0 and got[2].rejected == "" and got[2].chosen


def test_html(spark):
    nav = "<div class=nav><a href=/>Home</a> and <b>more</b></div>"
    rows = [(i, f"http://h.example/{i}", f"<html><body>{nav}<p>Body {i} &amp; text</p></body></html>", "c", "t") for i in range(5)]
    rows += [(5, "http://h.example/5", None, "c", "t"), (6, None, "", "c", "t"), (7, "no url", "<p>lone <b>tag", "c", "t"), (None, None, "<p>x</p>" * 20_000, "c", "t"), (0, "http://h.example/0", rows[0][2], "c", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, templates string")
    got = html_templates.extract(pages).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert by[3].text == "Body 3 & text" and by[3].removed == 1 and by[3].host == "h.example"
    assert by[5].text == by[6].text == "" and by[7].text == "lone tag"
    assert by[None].text.count("\n") == 19_999
    spread = {r.page_id: r.text for r in html_templates.extract(pages, broadcast_limit=0, salts=3).collect()}
    assert spread == {r.page_id: r.text for r in got}


def test_stages(spark, clashing, tmp_path, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (clashing, clashing.limit(0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{docs is clashing}-{k}-{name[:3]}-{out.count()}")
            if k < 4:
                assert out.columns == docs.columns
                path = f"{tmp_path}/stage-{k}-{id(docs)}"
                out.write.parquet(path)
                docs = spark.read.schema(out.schema).parquet(path)
