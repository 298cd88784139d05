"""Tokenizer files and one loaded tokenizer, with its distinct-piece table, for each worker process."""

from __future__ import annotations

import os

import numpy as np

from .pieces import Table, encoder

_LOADED: dict = {}

#: Where pieces may begin in texts for the tokenizers library's pattern-splitting BPE files.
BREAKS, MARKS = b" \n", b".,;:!?"


def public(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _once(key, make):
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def fast_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def load():
        out = Tokenizer.from_file(path)
        out.no_truncation()
        out.no_padding()
        return out

    return _once(("fast", path), load)


def fast_table(path: str, lengths: bool = False) -> Table:
    """Pieces to their ids as little-endian 32-bit bytes, or to the number of ids."""

    def load():
        tokenizer = fast_tokenizer(path)
        special = next(i for i, t in sorted(tokenizer.get_added_tokens_decoder().items()) if t.special)
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        marked = None
        if suffix:
            marked = np.zeros(tokenizer.get_vocab_size(True), bool)
            marked[[i for t, i in tokenizer.get_vocab(False).items() if t.endswith(suffix)]] = True
        encode = encoder(tokenizer, tokenizer.id_to_token(special), special, marked)
        return Table(lambda x: [len(b) >> 2 for b in encode(x)], 400_000) if lengths else Table(encode)

    return _once(("table", path, lengths), load)


def sentencepiece_model(path: str):
    import sentencepiece

    return _once(("sp", path), lambda: sentencepiece.SentencePieceProcessor(model_file=path))


def sentencepiece_table(path: str) -> Table:
    def load():
        model = sentencepiece_model(path)
        return Table(lambda x: [np.array(ids, "<u4").tobytes() for ids in model.encode(x, num_threads=1)], 200_000)

    return _once(("sp table", path), load)
