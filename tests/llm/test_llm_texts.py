"""Main text of pages, license scans, toxicity, mixing, the pipeline and the catalogue."""

import collections
import itertools
import math
import random

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
import edge
from compare import compare, duck
from gistmill.llm import catalogue, html_text, licenses, mixing, simhash, toxicity
from gistmill.llm.encoding import load
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


def test_tree_learns_its_table():
    x, y = html_text.labelled_blocks()
    wrong = sum(a != bool(b) for a, b in zip(html_text.tree().predict(x), y))
    assert len(y) > 80 and wrong <= 2


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("<p>", ""), ("no markup at all here", "no markup at all here"),
    ("<html><head><title>t</title><style>p{a:b}</style></head><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1>"
     "<p><b>one\n  two<br>three&nbsp;four<p>five six</article><footer>&copy; x and more</footer>", "A & B\n\none two three four\n\nfive six"),
    ("<body><script>var t='<p>not this text</p>'</script><!-- <p>nor this one</p> --><main><p>kept words stay</p></main>", "kept words stay"),
    ("<article><p>said it all</p><div class='comments'><p>I do not agree with that</p></div></article>", "said it all"),
    ("<div class=cookie-notice>We use cookies here</div><div id=main-content><p>real text &#233;&lt;b&gt;</p></div>", "real text é<b>"),
    ("<form><label>Name of user</label><input><select><option>a b c</select></form><article><p>words of it</p></article>", "words of it"),
    ("<article><p>a < b and c > d</p><p title='x > y'>next one</p>", "a < b and c > d\n\nnext one"),
    ("<article><p>never closed <i>italic", "never closed italic"), ("<article><p>half a tag</p><p cla", "half a tag"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_whole_long_pages():
    words = " ".join(f"w{i}" for i in range(200_000))
    assert html_text.main_text(f"<article><p>{words}</p></article>") == words


def brute_license(text):
    found = licenses.words(text)
    labels, best = set(), 0.0
    for template, label in licenses.TEMPLATES:
        whole = set(licenses.words(template))
        size = licenses.block_size(len(licenses.words(template)))
        for k in range(max(0, -(-(len(found) - size) // (size // 2))) + 1):
            share = len(whole & set(found[k * size // 2: k * size // 2 + size])) / len(whole)
            if share >= licenses.THRESHOLD:
                labels.add(label)
                best = max(best, share)
    places = []
    for phrase, label in licenses.PHRASES:
        want = phrase.encode().split()
        places += [(i, label) for i in range(len(found)) if found[i: i + len(want)] == want]
    labels |= {label for _, label in places}
    return (
        len(found), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
        ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if places else best,
    )


def test_licenses(spark):
    draw = random.Random(2)
    vocabulary = sorted({w.decode() for w in licenses.template_words()}) + ["mit license", "apache License", "General Public license", "foo", "é"]
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.choice([3, 20, 90, 300]))) for _ in range(80)]
    texts += [edge.text_of(k, 60) + " " + t + ". " + edge.text_of(k + 1, 60) for k, (t, _) in enumerate(licenses.TEMPLATES)]
    texts += ["MIT MIT License license mit license", "general public license-general PUBLIC license"]
    rows = [(100 + i, t, None, None, 0, *["x"] * 8) for i, t in enumerate(texts)] + edge.rows()
    got = licenses.license_labels(licenses.license_blocks(edge.documents(spark, rows))).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, *brute_license(t))) for i, t, *_ in rows)
    assert sum("bsd" in r.labels for r in got) >= 1
    assert licenses.license_labels(licenses.license_blocks(edge.documents(spark, []))).collect() == []


def test_templates_of_any_length_at_every_offset():
    draw = random.Random(4)
    filler = [f"filler{i}".encode() for i in range(40)]
    for n in (5, 31, 32, 33, 45, 64, 65, 128, 300):
        template = " ".join(f"notice{draw.randrange(n)}" for _ in range(n))
        index = licenses.Index({}, [(template, "x"), ("short words", "y")])
        for offset in range(0, 2 * n + 70):
            text = [draw.choice(filler) for _ in range(offset)] + licenses.words(template) + [draw.choice(filler) for _ in range(200)]
            assert any(number == 0 and much == 1 for number, _, _, much in index.blocks(text)), (n, offset)
    assert max(licenses.block_size(len(licenses.words(t))) for t, _ in licenses.TEMPLATES) > licenses.BLOCK
    for template, label in licenses.TEMPLATES:
        assert label in brute_license("some words " * 30 + template)[5].split(",")


def tables(spark, folder):
    return [spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels")]


def test_toxicity_held_out(spark):
    documents, labels = tables(spark, "/root/testdata/sf0.1")
    model = toxicity.train(documents, labels)
    scored = toxicity.toxicity_scores(documents, model).where("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    caught = sum(r.toxic == 1 and r.predicted == 1 for r in scored)
    assert caught >= 0.65 * sum(r.toxic == 1 for r in scored)
    assert sum(r.toxic == 0 and r.predicted == 1 for r in scored) <= 0.01 * sum(r.toxic == 0 for r in scored)


def test_toxicity_learns_from_the_other_rows_only(spark):
    documents, labels = tables(spark, FOLDER)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = toxicity.train(documents, labels), toxicity.train(documents, changed)
    assert (one.toxic, one.ordinary, one.weights) == (two.toxic, two.ordinary, two.weights)
    assert {toxicity.remainder(i) == 1 for i in range(50)} == {True, False}


def test_fitted_in_a_task_as_anywhere(spark):
    documents, labels = tables(spark, "/root/testdata/sf0.01")
    sample = toxicity.labelled_sample(documents, labels, "doc_id", "text", "toxic").collect()
    assert toxicity.train(documents, labels) == toxicity.fit([(r.toxic, r.text) for r in sample])
    assert len(sample) > 50 and not any(r.text is None for r in sample)


def prose(draw, own=()):
    """Sixty made-up words and some of one's own."""
    found = ["".join(draw.choice(["ka", "lo", "mi", "ter", "su", "ne"]) for _ in range(draw.randrange(1, 5))) for _ in range(60)]
    for word in own:
        found.insert(draw.randrange(len(found)), word)
    return " ".join(found)


def test_toxic_words_of_few_and_many_texts():
    """Words of 12 toxic texts in 1,000 are learnt, and more words than any fixed dictionary would hold."""
    draw = random.Random(5)
    rare = [(1, prose(draw, ["grobvok"] if i < 12 else ["dwazpig"])) for i in range(1000)]
    model = toxicity.fit([(0, prose(draw)) for _ in range(1000)] + rare)
    assert model.score(prose(draw, ["grobvok"])) > toxicity.THRESHOLD > model.score(prose(draw))
    letters = "bcdfghjpqvwxyz"
    insults = ["".join(draw.choice(letters) for _ in range(7)) for _ in range(120)]
    many = [(1, prose(draw, draw.sample(insults, 4))) for _ in range(600)]
    model = toxicity.fit([(0, prose(draw)) for _ in range(1000)] + many)
    caught = [model.score(prose(draw, draw.sample(insults, 4))) >= toxicity.THRESHOLD for _ in range(100)]
    clean = [model.score(prose(draw)) >= toxicity.THRESHOLD for _ in range(100)]
    assert len(model.toxic) > 600 and sum(caught) >= 95 and sum(clean) <= 1


def test_scores_against_plain_compression(spark):
    """Every gain computed anew from compressed lengths, without what a worker remembers."""
    documents, labels = tables(spark, "/root/testdata/sf0.01")
    model = toxicity.train(documents, labels)
    lead = toxicity.LEAD
    cuts = [model.ordinary[len(model.ordinary) - k * lead:][:lead] for k in range(2, 2 + 2 * toxicity.FRAMES)]

    def plainly(text):
        hits, found = {}, toxicity.words(text)
        for word in set(found):
            gain = 0
            for before, behind in zip(cuts[::2], cuts[1::2]):
                short, long = (len(c.compress(before + b" " + word + b" " + behind)) for c in model.pair())
                gain += short - long
            if gain >= model.least_gain:
                hits[word] = gain
        n, share = len(hits), len(hits) / max(len(found), 1)
        much = sum(gain >= model.least_gain + toxicity.MUCH for gain in hits.values())
        x = [1, n >= 1, n >= 2, n >= 3, math.log(1 + n), math.log(1 + much), math.sqrt(share), min(25 * share, 1)]
        return 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights))))

    got = toxicity.toxicity_scores(documents, model).join(documents.select("doc_id", "text"), "doc_id").limit(300).collect()
    assert all(r.score == pytest.approx(plainly(r.text), abs=1e-9) for r in got) and {r.predicted for r in got} == {0, 1}


def test_toxicity_of_odd_rows(spark):
    documents, labels = tables(spark, FOLDER)
    model = toxicity.train(documents, labels)
    got = toxicity.toxicity_scores(edge.documents(spark), model).collect()
    assert len(got) == len(edge.rows()) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert toxicity.toxicity_scores(edge.documents(spark, []), model).collect() == []
    nothing = toxicity.train(documents.limit(0), labels)
    assert [r.score for r in toxicity.toxicity_scores(edge.documents(spark), nothing).select("score").distinct().collect()] == [0.0]


def test_mixture_of_odd_rows(spark):
    got = mixing.mixture(edge.documents(spark)).toPandas().astype({"doc_id": "Int64"})
    connection = duck(FOLDER)
    odd = edge.documents(spark).select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})
    connection.register("odd", odd)
    expected = connection.execute(mixing.mixture_sql("odd", "1.0::DOUBLE")).df()
    key = ["doc_id", "size", "source_size", "target", "taken"]
    assert sorted(map(repr, got[key].astype(str).values.tolist())) == sorted(map(repr, expected[key].astype(str).values.tolist()))
    assert mixing.mixture(edge.documents(spark, [])).collect() == []


def test_mix_epochs_caps_and_weights(spark):
    rows = [(i, "w " * 10, None, s, 0, *["x"] * 8) for i, s in enumerate(["a"] * 10 + ["b"] * 200 + ["c"] * 190)]
    got = mixing.mixture(edge.documents(spark, rows)).join(edge.documents(spark, rows).select("doc_id", "source"), "doc_id")
    by = {r.source: r for r in got.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("taken").alias("m")).collect()}
    # 4000 words; a stops at 300, the rest goes 2 : 1
    assert by["a"].t == 300 and by["b"].t == pytest.approx(3700 * 2 / 3) and by["c"].t == pytest.approx(3700 / 3)
    assert all(abs(r.t - r.k) <= 10 for r in by.values()) and by["a"].m == 30
    mixed = mixing.mixed_documents(edge.documents(spark, rows))
    assert mixed.columns == edge.documents(spark, rows).columns
    assert {r.source: 10 * r["count"] for r in mixed.groupBy("source").count().collect()} == {s: r.k for s, r in by.items()}
    quality = spark.createDataFrame([(i, 50.0) for i in range(0, 400, 2)] + [(1, -3.0), (3, None), (None, 9.0)], "doc_id bigint, weight double")
    heavy = mixing.mixture(edge.documents(spark, rows), quality=quality)
    sums = {r.even: r.s for r in heavy.where("doc_id >= 210").groupBy((F.col("doc_id") % 2 == 0).alias("even")).agg(F.sum("taken").alias("s")).collect()}
    assert sums[True] > 1.5 * sums[False]


def test_equal_rows_are_told_apart(spark):
    rows = [(1, "one two", None, "a", 0, *["x"] * 8)] * 5 + [(2, "three four", None, "b", 0, *["x"] * 8)] * 4
    mixed = mixing.mixed_documents(edge.documents(spark, rows)).groupBy("doc_id").count().collect()
    taken = mixing.mixture(edge.documents(spark, rows)).groupBy("doc_id").agg(F.sum("taken").alias("t")).collect()
    assert {r.doc_id: 2 * r["count"] for r in mixed} == {r.doc_id: r.t for r in taken}


@pytest.mark.parametrize("name", sorted(catalogue.SQLS))
def test_query_with_sql(spark, name):
    assert compare(spark, duck(FOLDER), FOLDER, catalogue.QUERIES[name], catalogue.SQLS[name]) is None


def test_catalogue_is_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in catalogue.QUERIES}
    assert set(catalogue.QUERIES) | {"pipeline"} <= names


def test_pipeline(spark):
    """Each stage on the rows of the one before, against what plain Python or the operator's other form says of them."""
    documents, labels = tables(spark, FOLDER)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, documents, FOLDER).cache()
    scores = toxicity.toxicity_scores(documents, toxicity.train(documents, labels)).collect()
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    assert ids(kept) == sorted(r.doc_id for r in scores if r.predicted == 0) and kept.columns == documents.columns

    single = stages["near-copies"](spark, kept, FOLDER).cache()
    prints = [(r.doc_id, simhash.fingerprint(r.text)) for r in kept.select("doc_id", "text").collect()]
    near = [(a, b) for (a, x), (b, y) in itertools.combinations(prints, 2) if (x ^ y).bit_count() <= 4]
    assert near and ids(single) == sorted(set(edge.components([i for i, _ in prints], near).values()))
    assert single.columns == documents.columns

    mixed = stages["mix"](spark, single, FOLDER).cache()
    taken = mixing.mixture(single, quality=catalogue.quality_weights(labels)).where("size > 0").collect()
    copies = collections.Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert all(copies[r.doc_id] * r.size == r.taken for r in taken) and mixed.columns == documents.columns and max(copies.values()) <= 3
    assert mixed.join(documents, documents.columns, "left_anti").count() == 0

    packed = stages["packing"](spark, mixed, FOLDER)
    library = load(public_tokenizers.path(catalogue.WORD_BPE))
    texts = [r.text or "" for r in mixed.select("text").collect()]
    assert packed.agg(F.sum("length")).first()[0] == sum(len(e.ids) + 1 for e in library.encode_batch(texts, add_special_tokens=False))
    whole = corpus_pipeline.run(spark, FOLDER)
    pieces = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole.select(pieces).collect()) == sorted(packed.select(pieces).collect())


def test_empty_documents_stay_within_the_cap(spark):
    rows = [(i, "one two three" if i else "", None, "a", 0, *["x"] * 8) for i in range(8)]
    rows += [(100 + i, "word " * 40, None, "b", 0, *["x"] * 8) for i in range(30)]
    counts = {r.doc_id: r["count"] for r in mixing.mixed_documents(edge.documents(spark, rows)).groupBy("doc_id").count().collect()}
    assert counts[1] == 3 and counts[0] == 3


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_names(spark, stage):
    odd = ["_own", "_rows", "_row", "_times", "_named", "_hash", "_key", "_id", "_document", "_part", "_copy", "print", "root", "size", "a.b", "col"]
    plain = edge.documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    clashing = plain.select("*", *[F.lit(name).alias(name) for name in odd])
    function = dict(corpus_pipeline.STAGES)[stage]
    out, expected = function(spark, clashing, FOLDER), function(spark, plain, FOLDER)
    if stage == "packing":
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert sorted(map(repr, out.select(names).collect())) == sorted(map(repr, expected.select(names).collect()))
        return
    assert out.columns == clashing.columns
    for r in out.collect():
        assert [r[len(plain.columns) + i] for i in range(len(odd))] == odd
    first = [sorted(map(repr, (tuple(r)[:5] for r in frame.collect()))) for frame in (out, expected)]
    if stage == "mix":  # which of equal ids is taken first goes by a hash of the whole row
        first = [sorted({row for row in rows}) for rows in first]
    assert first[0] == first[1]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    out = dict(corpus_pipeline.STAGES)[stage](spark, edge.documents(spark), FOLDER)
    assert out.count() > 0
    assert dict(corpus_pipeline.STAGES)[stage](spark, edge.documents(spark, []), FOLDER).count() == 0
