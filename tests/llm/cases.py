"""Documents with the hard cases: null, empty and long texts, repeats, special strings, clashing columns."""

TEXTS = [
    None, "", " ", "\n\t", "one", "one two", "a  b", " lead", "trail ", "It's we'll 's 're.",
    "x <|endoftext|> y<|endoftext|>z a|>b <|startoftext|>.q <s> </s>",
    "café é ñ́. 日本語 テスト。 　 a  b  c ≮ .̸ İ ΑΣ ς ﬁ", "▁a ▁▁b a▁b", "ab\ncd\n\nef \n g\r\n h",
    "w" * 3000, " ".join(f"tok{i % 37}" for i in range(4000)), "same words here again " * 30, "same words here again " * 30,
    "a\x00b \x1c c\x85 d​ e", "😀 😀😀 x",
]


def documents(spark, texts=None):
    rows = [(i, t, "en", "src0", len(t or ""), "extra") for i, t in enumerate(TEXTS if texts is None else texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
