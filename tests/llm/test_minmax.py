import numpy as np

from bidlattice.llm import jaccard, minmax, words

from .cases import documents
from .test_jaccard import brute, made


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    texts = made()
    rows = minmax.dedup(documents(spark, texts).repartition(5), 5, (85, 100)).collect()
    want = brute(texts, 5, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want
    assert {r.doc_id: r.kept for r in rows} == {d: d == c for d, (_, c) in want.items()}


def test_values_match_as_often_as_sets_are_alike():
    """Each band of one row is equal with the chance of the sets' similarity, by minima and by maxima."""
    rng = np.random.default_rng(4)
    n, both, apart = 3000, 17, 3
    sets = []
    for _ in range(n):
        x = rng.integers(0, 2**63, both + apart).astype(np.uint64)
        sets += [np.sort(x[:both]), np.sort(x)]
    bounds = np.append(0, np.cumsum([len(s) for s in sets]))
    found = minmax.bands(np.concatenate(sets), bounds, groups=4, rows=1)
    same = (found[::2] == found[1::2]).mean(0)
    assert np.abs(same - both / (both + apart)).max() < 0.03
    of_six = minmax.bands(np.concatenate(sets), bounds, minmax.groups_of(0.85))
    assert of_six.shape[1] == 44 and (of_six[::2] == of_six[1::2]).any(1).all()
    assert abs((of_six[::2] == of_six[1::2]).mean() - 0.85**6) < 0.02


def test_groups_for_a_chance_of_a_miss():
    assert (1 - 0.85**6) ** (2 * minmax.groups_of(0.85)) <= minmax.MISS
    assert minmax.groups_of(1.0) >= 1


def test_null_and_shared_ids_extra_columns_and_no_rows(spark):
    t = " ".join(f"a{i}" for i in range(60))
    rows = [(5, t, 1), (5, "other words altogether here now", 2), (7, t + " b", 3), (None, t, 4), (None, "lone", 5), (None, None, 6), (8, "", 7), (9, "LONE", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in minmax.dedup(docs).collect())
    assert got == [(0, 0, 0, True), (0, 1, 9, False), (0, 56, 5, False), (5, 1, 5, True), (5, 56, 5, True), (7, 57, 5, False), (8, 0, 8, True), (9, 1, 9, True)]
    assert minmax.dedup(docs.limit(0)).count() == 0


def thue_morse(n):
    out = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return out, out.translate(str.maketrans("ab", "ba"))


def test_crafted_words_are_told_apart():
    x, y = thue_morse(4096)
    data = np.frombuffer(f"{x} {y} {x}".encode(), np.uint8)
    found = words.word_digests(words.words(data, np.array([0, len(data)]), words.NON_SPACE))
    assert (found[0] == found[2]).all() and (found[0] != found[1]).all() and found[0, 0] != found[0, 1]
    empty = words.words(np.zeros(0, np.uint8), np.zeros(1, np.int64), words.NON_SPACE)
    assert words.word_digests(empty).shape == (0, 2)


def test_hashes_of_words_of_all_lengths():
    """Equal words have equal hashes wherever they stand; words that differ in a byte, or by being longer, have others."""
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in range(1, 60) for _ in range(30)] + [b"a", b"aa", b"\xc3\xa9", b"a" * 24, b"a" * 25]
    joined = b" ".join(texts + texts[::-1])
    found = words.words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), words.NON_SPACE)
    hashes = words.word_digests(found)
    assert [found.word(i) for i in range(len(hashes))] == texts + texts[::-1]
    for k in (0, 1):
        assert (hashes[: len(texts), k] == hashes[len(texts) :, k][::-1]).all() and len(np.unique(hashes[:, k])) == len(set(texts))
    assert len(np.unique(hashes)) == 2 * len(set(texts))
