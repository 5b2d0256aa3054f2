"""Token ids by a public tokenizer, with a bounded store of words in each Python worker."""

from __future__ import annotations

import os
from string import punctuation
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def tokenizer_path(name: str) -> str:
    """Where this machine keeps a public tokenizer's file; called in tasks, so that it may differ by machine."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def _list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Encode texts word by word; gives the same ids as encoding whole texts.

    The tokenizer's pre-tokenizer never joins characters across ASCII white space and normalises each character run
    between white space alone, so a text's ids are those of its words in turn; and it ignores case. Arrow puts ASCII
    letters in lower case, parts a batch of texts into words, takes the signs off the ends of letters, numbers what is
    distinct, and lays the ids of all words end to end; only new words go through the tokenizer. Those of letters are
    encoded many at once, as each gives ids up to one that ends a word. At most `limit` words are kept.
    """

    def __init__(self, name: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.by_letters = bool(self.ends.any())
        # for normal lower-case letters, which need no normaliser and are parted by white space alone
        self.plain = Tokenizer.from_file(tokenizer_path(name))
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.limit, self.known = limit, {}

    def forget(self) -> None:
        self.known = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case letters: the ids of all, cut behind each that ends a word."""
        ids = np.array(self.plain.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            return self._ids(words)
        at = [0, *(cuts * self.dtype.itemsize).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _learn(self, words: list[str]) -> None:
        letters, others = [], []
        for w in words:
            plain = self.by_letters and w.isalpha() and (w.isascii() or max(w) < "\u0500" and w == w.lower() and is_normalized("NFC", w))
            (letters if plain else others).append(w)
        if letters:
            self.known.update(zip(letters, self._letter_ids(letters), strict=True))
        if others:
            self.known.update(zip(others, self._ids(others), strict=True))

    def _look_up(self, words: list[str]) -> pa.Array:
        """The ids of distinct words, as bytes."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.forget()
            new = words
        if new:
            self._learn(new)
        known = self.known
        return pa.array([known[w] for w in words], pa.binary())

    def _words(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        words = lists.flatten().dictionary_encode()
        whole, base = words.dictionary, pc.utf8_rtrim(words.dictionary, punctuation)
        plain = pc.utf8_is_alpha(base)  # else the signs may belong to a longer run
        base = pc.if_else(plain, base, whole).dictionary_encode()
        ids = self._look_up(_list(base.dictionary)).take(base.indices)
        has_tail = pc.less(pc.binary_length(base.dictionary.take(base.indices)), pc.binary_length(whole))
        tails = [w[len(w.rstrip(punctuation)) :] for w in _list(whole.filter(has_tail))]
        if tails:
            tail = pa.array(tails).dictionary_encode()
            behind = self._look_up(_list(tail.dictionary)).take(tail.indices)
            ids = pc.replace_with_mask(ids, has_tail, pc.binary_join_element_wise(ids.filter(has_tail), behind, b""))
        stream = ids.take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(stream).to_numpy(), dtype=np.int64)])
        counts = np.diff(ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])])
        data = stream.buffers()[2]
        return (data.to_pybytes()[: ends[-1]] if data else b""), counts // self.dtype.itemsize

    def encode(self, texts: pa.Array, chunk_bytes: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and how many each has (nulls have none)."""
        texts = texts.fill_null("")
        if any(pc.any(pc.match_substring(texts, s, ignore_case=True)).as_py() for s in self.special):
            made = self._ids(texts.to_pylist())  # tokens that are written out have a case
            return np.frombuffer(b"".join(made), self.dtype), np.array([len(x) // self.dtype.itemsize for x in made], np.int64)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        ids, counts, at = [], [np.empty(0, np.int64)], 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk_bytes, "right")))
            raw, n = self._words(texts.slice(at, to - at))
            ids.append(raw)
            counts.append(n)
            at = to
            pa.default_memory_pool().release_unused()
        return np.frombuffer(b"".join(ids), self.dtype), np.concatenate(counts)


_ENCODERS: dict[str, WordEncoder] = {}


def word_encoder(name: str) -> WordEncoder:
    """The encoder of this Python worker; tasks that run in it one after the other share its store of words."""
    if name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name] = WordEncoder(name)
    return _ENCODERS[name]


def forget_words() -> None:
    """Give back the memory of this worker's store of words, for tasks that encode nothing."""
    for encoder in _ENCODERS.values():
        encoder.forget()
