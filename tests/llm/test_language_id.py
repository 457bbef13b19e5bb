import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from latticework.llm import language_id as L
from latticework.llm._arrow import split_words

LONG = "doc_id long, text string, lang string"


def slow_viterbi(score, penalty):
    n, s = score.shape
    v, back = score[0].astype(float), []
    for t in range(1, n):
        top = int(v.argmax())
        back.append([x if v[x] >= v[top] - penalty else top for x in range(s)])
        v = np.maximum(v, v[top] - penalty) + score[t]
    state = int(v.argmax())
    path = [state]
    for b in reversed(back):
        state = b[state]
        path.append(state)
    return path[::-1]


def path_score(score, path, penalty):
    return sum(score[t, x] for t, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(5)
    for states in (2, 3, 4):
        for block in (1, 3, 64):
            counts = rng.integers(0, 40, 12)
            at = np.concatenate([[0], np.cumsum(counts)])
            score = rng.integers(-3, 4, (at[-1], states)).astype(float)
            got = L.viterbi(score, at, 2.0, block)
            for a, b in zip(at, at[1:]):
                if b > a:
                    best = path_score(score[a:b], slow_viterbi(score[a:b], 2.0), 2.0)
                    assert path_score(score[a:b], got[a:b], 2.0) == best


def test_scripts_and_mixed_spans(spark):
    rows = [(i, "the cat sat on the mat with the other thing that was there", "en") for i in range(5)]
    rows += [(10 + i, "der hund und die katze sind nicht auf dem tisch gewesen", "de") for i in range(5)]
    docs = spark.createDataFrame([*rows, (20, "the cat was with the other thing. Привет мир как дела. 中文 42", None), (21, None, None), (22, " ?! ", "en")], LONG)
    model = L.fit(docs)
    got = {}
    for r in L.spans(docs, model).orderBy("doc_id", "span").collect():
        got.setdefault(r.doc_id, []).append(r)
    assert [r.lang for r in got[20]] == ["en", "ru", "zh"]
    assert [(r.first_word, r.n_words) for r in got[20]] == [(0, 7), (7, 4), (11, 2)]
    text = rows and "the cat was with the other thing. Привет мир как дела. 中文 42"
    assert text[got[20][1].char_start : got[20][1].char_end] == "Привет мир как дела"
    assert [(r.lang, r.n_words) for r in got[21]] == [("und", 0)] == [(r.lang, r.n_words) for r in got[22]]
    assert {r.lang for i in range(5) for r in got[i]} == {"en"} and {r.lang for i in range(10, 15) for r in got[i]} == {"de"}


def test_mixed_text_is_cut_where_the_language_changes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 400")
    model = L.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1").select("doc_id", "lang", F.substring("text", 60, 300).alias("text"))
    en, de = held.filter("lang = 'en'").limit(20).toPandas(), held.filter("lang = 'de'").limit(5).toPandas()
    a, b = en["text"][0], de["text"][0]
    names, score, _ = model.scores(w := split_words(pa.array([a + " " + b])))
    path = L.viterbi(score, w.at, 12.0)
    cut = split_words(pa.array([a])).at[1]
    right = (np.array(names)[path] == np.where(np.arange(len(path)) < cut, "en", "de")).mean()
    assert right > 0.95


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1")
    spans = L.spans(held, model).groupBy("doc_id", "lang").agg(F.sum("n_words").alias("n")).groupBy("doc_id").agg(F.max_by("lang", "n").alias("got"))
    n, right = held.join(spans, "doc_id").agg(F.count("*"), F.sum((F.col("got") == F.col("lang")).cast("int"))).first()
    assert right / n > 0.97


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], LONG)
    assert L.spans(empty).count() == 0
    odd = spark.createDataFrame([(1, "the cat", "en", 5, "x"), (1, "the cat", "en", 5, "x")], LONG + ", span long, char_start string")
    assert [r.lang for r in L.spans(odd).collect()] == ["en", "en"]


def test_sample_is_the_first_hashes_of_each_label(spark):
    rows = [(k % 900, ["en", "de", None][k % 3 if k % 7 else 0], f"text {k}" if k % 11 else "") for k in range(3000)]
    docs = spark.createDataFrame(rows + [(5, "en", "text again")] * 500, "doc_id long, lang string, text string")
    h = {r.doc_id: r.h for r in docs.select("doc_id", F.expr("xxhash64(doc_id) & 9223372036854775807").alias("h")).distinct().collect()}
    want = []
    for lang in ("en", "de"):
        first = {}
        for i, x, t in [*rows, (5, "en", "text again")]:
            if x == lang and t:
                first[h[i]] = min(first.get(h[i], t), t)
        want += [(lang, first[k]) for k in sorted(first)[:40]]
    for limit in (10, 0):
        assert sorted(tuple(r) for r in L.sample(docs, 40, limit, 3).collect()) == sorted(want)


def plain_spans(model, text, penalty=12.0):
    """The whole operator on one text, a word and a byte at a time."""
    low = (text or "").lower()
    words = [(m.start(), m.end()) for m in re.finditer(r"[0-9a-z\u0080-\U0010ffff]+", low)]
    if not words:
        return [("und", 0, 0, 0, 0)]
    script = []
    for a, z in words:
        kinds = [L._RANGES[bisect.bisect_right([r[0] for r in L._RANGES], ord(c)) - 1][1] for c in low[a:z]]  # noqa: SLF001
        script.append(next((k for k in kinds if k != "common"), None))
    present = {k for k in script if k}
    if not present:
        return [("und", 0, len(words), words[0][0], words[-1][1])]
    main = {lang: L.SCRIPTS[m] for lang, m in zip(model.langs, model.main)}
    usual = {L.USUAL[k]: k for k in present if k not in main.values()}
    names = sorted({*(x for x, m in main.items() if m in present), *usual})
    score = np.zeros((len(words), len(names)), np.float32)
    for t, ((a, z), k) in enumerate(zip(words, script)):
        raw = b" " + low[a:z].encode() + b" "
        for j, name in enumerate(names):
            if k is None:
                continue
            if main.get(name) == k:
                table = model.table[model.langs.index(name)]
                score[t, j] = sum(float(table[((raw[i - 1] << 16 | raw[i] << 8 | raw[i + 1]) * 2654435761 & 0xFFFFFFFF) >> 16]) for i in range(1, len(raw) - 1))
            elif usual.get(name) != k:
                score[t, j] = -1e9
    path = slow_viterbi(score, penalty)
    out = []
    for t, x in enumerate(path):
        if t and x == path[t - 1]:
            out[-1] = (*out[-1][:2], out[-1][2] + 1, out[-1][3], words[t][1])
        else:
            out.append((names[x], t, 1, *words[t]))
    return out


def test_query_equals_its_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = L.fit(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(-1, "12 34 - 5"), (-2, "Das ist nicht der Anfang. Привет мир как дела 42"), (-3, rows[0][1][:200] + " 中文 12 " + rows[1][1][:200]), (-4, None), (-5, "7 λόγος")]
    got = {}
    for r in L.spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).orderBy("doc_id", "span").collect():
        got.setdefault(r.doc_id, []).append((r.lang, r.first_word, r.n_words, r.char_start, r.char_end))
    differs = [i for i, t in rows if got[i] != plain_spans(model, t)]
    assert not differs
