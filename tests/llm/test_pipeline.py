import corpus_pipeline
from bidlattice.llm import quality, sentence_pieces, vocab
from bidlattice.session import stored

from .test_decontaminate import brute as brute_hits
from .test_jaccard import brute as brute_groups
from .test_substrings import brute as brute_repeats

DATA = "/root/testdata/sf0.001"


def test_each_stage_equals_brute_force_on_its_own_input(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("quality_classifier", "jaccard_join", "substring_dedup", "decontamination", "sentence_pieces")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).filter("keep").collect()}
    kept = stored(stages[0](spark, docs, DATA), "one")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == scored

    rows = sorted(kept.collect())
    groups = brute_groups([r.text for r in rows], 5, 80, 100)
    two = stored(stages[1](spark, kept, DATA), "two")
    assert sorted(two.collect()) == [r for i, r in enumerate(rows) if groups[i][1] == i]

    rows = sorted(two.collect())
    cut = brute_repeats([r.text for r in rows])
    three = stored(stages[2](spark, two, DATA), "three")
    want = {r.doc_id: (k if n else r.text) for r, (_, n, k) in zip(rows, cut.values(), strict=True) if not n or k}
    assert {r.doc_id: r.text for r in three.collect()} == want and any(n for _, n, _ in cut.values())

    rows = sorted(three.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    hits = brute_hits([r.text for r in rows], items)
    four = stored(stages[3](spark, three, DATA), "four")
    assert sorted(four.collect()) == [r for i, r in enumerate(rows) if not hits[i][1]] and four.count() < three.count()

    model = vocab.sentencepiece_model(vocab.public(sentence_pieces.MODEL))
    five = {r.doc_id: list(r.ids) for r in stages[4](spark, four, DATA).collect()}
    assert five == {r.doc_id: model.encode(r.text, add_bos=True, add_eos=True) for r in four.collect()}
    whole = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert whole == five


def test_near_duplicates_with_null_or_shared_ids(spark):
    def text(seed, last="end"):
        return " ".join(f"w{seed}x{i}" for i in range(60)) + f" {last}"

    rows = [
        (1, text(1)), (None, text(1)), (None, text(1, "near")),  # linked with a document that has an id
        (None, text(2)), (None, text(2)), (None, text(2, "near")),  # null ids alone: one stays
        (None, text(3)), (None, ""), (None, None), (2, ""),
        (3, text(4)), (4, text(4, "near")), (4, text(5)), (4, text(5, "near")),  # 4 stays with its other text only
    ]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert got.schema == docs.schema
    got = [(r.doc_id, r.text) for r in got.collect()]
    alone = [r for r in got if r[0] is None and r[1] and "w2x" in r[1]]
    assert len(alone) == 1
    want = [(1, text(1)), (None, text(3)), (None, ""), (None, None), (2, ""), (3, text(4)), (4, text(5)), (4, text(5, "near"))]
    assert sorted(map(repr, got)) == sorted(map(repr, want + alone))
