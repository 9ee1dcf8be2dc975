"""Subword ids of whole texts with a public tokenizer file, word by word.

The word-level BPE drops white space before it splits, so a text's ids are the
concatenated ids of its words; each distinct word of a batch is encoded once, and kept
under its name (its own bytes, or the digest of a long one) for later batches.
"""

from __future__ import annotations

from itertools import batched, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from memloom.llm.textio import held, mixed, plain, ragged, word_names, words

#: Words a worker keeps encoded; beyond that it drops the half that it has not met for longest.
CACHE_WORDS = 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Encodes distinct words once; the ids of word i of ``keys`` are at ``firsts[i]`` in ``pool``."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The steps before the vocabulary: the file's own, and bare ones for words that normalising and splitting leave alone.
        self.own = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.bare = (normalizers.Sequence([]), pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False, trim_offsets=False)]))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.stops = {c: self._encode([c])[0][0] for c in ",."}
        self.ends_word = np.zeros(self.vocabulary, dtype=bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends_word[i] = token.endswith("</w>")
        self.keys, self.names = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
        self.pool, self.firsts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.round, self.met = 0, np.zeros(0, np.int32)  # calls of encode_words, and the last that met each word

    def forget(self) -> None:
        """Keep the half of the words that were met last."""
        kept = np.sort(np.argsort(-self.met, kind="stable")[: len(self.met) // 2])
        sizes = self.sizes[kept].astype(np.int64)
        self.pool = self.pool[ragged(self.firsts[kept], sizes)]
        self.keys, self.names, self.sizes, self.met = self.keys[kept], self.names[kept], self.sizes[kept], self.met[kept]
        self.firsts = np.cumsum(sizes) - sizes

    def _run(self, steps: tuple, texts: list[str]) -> list:
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = steps
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._run(self.own, texts)]

    def _encode_stems(self, stems: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many stems and the number of each. Words of letters alone go as one
        text: only the last id of such a word ends a word."""
        simple = pc.match_substring_regex(stems, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$").to_numpy(zero_copy_only=False)
        sizes = np.zeros(len(stems), dtype=np.int64)
        joined = [" ".join(x) for x in batched(stems.filter(pa.array(simple)).to_pylist(), 2000)]
        flat = np.fromiter(chain.from_iterable(x.ids for x in self._run(self.bare, joined)), dtype=np.uint32)
        ends = np.flatnonzero(self.ends_word[flat])
        sizes[simple] = np.diff(ends, prepend=-1)
        rest = self._encode(stems.filter(pa.array(~simple)).to_pylist())
        sizes[~simple] = np.fromiter(map(len, rest), dtype=np.int64, count=len(rest))
        firsts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), dtype=np.uint32)
        ids[ragged(firsts[simple], sizes[simple])] = flat
        ids[ragged(firsts[~simple], sizes[~simple])] = np.fromiter(chain.from_iterable(rest), dtype=np.uint32)
        return ids, sizes

    def _find(self, keys: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Places of known words, -1 for others. Names decide; a few words may share a key."""
        out = np.full(len(keys), -1, dtype=np.int64)
        at, open_ = np.searchsorted(self.keys, keys), np.arange(len(keys))
        while len(open_):
            open_ = open_[at[open_] < len(self.keys)]
            open_ = open_[self.keys[at[open_]] == keys[open_]]
            met = (self.names[at[open_]] == names[open_]).all(axis=1)
            out[open_[met]] = at[open_[met]]
            open_ = open_[~met]
            at[open_] += 1
        return out

    def _keep(self, keys: np.ndarray, names: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(keys, kind="stable")
        firsts = (len(self.pool) + np.cumsum(sizes) - sizes)[order]
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.names = np.insert(self.keys, at, keys[order]), np.insert(self.names, at, names[order], axis=0)
        self.firsts, self.sizes = np.insert(self.firsts, at, firsts), np.insert(self.sizes, at, sizes[order].astype(np.int32))
        self.met = np.insert(self.met, at, self.round)
        self.pool = np.concatenate([self.pool, ids])

    def _add(self, fresh: pa.Array, keys: np.ndarray, names: np.ndarray) -> None:
        """Encode new words. A stop after an ASCII letter is a piece of its own, so "word," is "word" and ","."""
        stopped = pc.match_substring_regex(fresh, "[a-z][,.]$").to_numpy(zero_copy_only=False)
        if not stopped.all():
            ids, sizes = self._encode_stems(fresh.filter(pa.array(~stopped)))
            self._keep(keys[~stopped], names[~stopped], ids, sizes)
        if stopped.any():
            whole = fresh.filter(pa.array(stopped))
            stems = pc.utf8_slice_codeunits(whole, 0, -1).dictionary_encode()
            firsts, sizes = self.places(stems.dictionary)
            code = stems.indices.to_numpy(zero_copy_only=False)
            stem_sizes = sizes[code].astype(np.int64)
            ids = np.zeros(int(stem_sizes.sum()) + len(code), dtype=np.uint32)
            begins = np.cumsum(stem_sizes + 1) - stem_sizes - 1
            ids[ragged(begins, stem_sizes)] = self.pool[ragged(firsts[code], stem_sizes)]
            ids[begins + stem_sizes] = np.where(pc.ends_with(whole, ",").to_numpy(zero_copy_only=False), self.stops[","], self.stops["."])
            self._keep(keys[stopped], names[stopped], ids, stem_sizes + 1)

    def places(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in ``pool``, and how many there are."""
        names = np.stack(word_names(distinct), axis=1)
        keys = mixed(names[:, 0], names[:, 1])
        at = self._find(keys, names)
        if (at < 0).any():
            new = np.flatnonzero(at < 0)
            self._add(distinct.take(pa.array(new)), keys[new], names[new])
            at = self._find(keys, names)
        self.met[at] = self.round
        return self.firsts[at], self.sizes[at]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the offsets of each text."""
        texts = plain(texts)
        special = pc.any(pc.match_substring(texts, "<|")).as_py()  # special tokens are told by case
        return self.encode_words(*words(texts, lower=not special))

    def encode_words(self, codes: np.ndarray, offsets: np.ndarray, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts that ``words`` has split. It lower-cases A-Z, so no text may hold "<|"."""
        self.round += 1
        if len(self.keys) > CACHE_WORDS:
            self.forget()
        firsts, sizes = self.places(distinct)
        lengths = sizes[codes].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.pool[ragged(firsts[codes], lengths)], ends[offsets]


#: The name under which a worker holds encoders.
HELD = "encoders"


def encoder(path: str) -> WordEncoder:
    """This worker's encoder of ``path``; one is held at a time."""
    encoders = held(HELD, dict)
    if path not in encoders:
        encoders.clear()
        encoders[path] = WordEncoder(path)
    return encoders[path]
