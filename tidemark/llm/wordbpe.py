"""Exact ids of a word-level BPE (lower case, white space dropped), by a cache of word pieces.

The tokenizer splits at white space before its merges, and its normalizer never looks across white space,
so a text's ids are the joined ids of its blank-separated chunks. A plain ASCII chunk falls further into
the pre-tokenizer's pieces. Other chunks are encoded whole. Both caches are bounded.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.textkit import Words, mix, ranges, raw_bytes

PIECE_CACHE, CHUNK_CACHE = 100_000, 1_000_000
# Fixed: the pre-tokenizer's pieces for lower-case ASCII.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
BLANK = re.compile(r"[ \t\n\v\f\r]+")
_loaded: dict[str, WordBpe] = {}


def default_path() -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load(path: str | None) -> WordBpe:
    """One encoder for each worker process and path; None: the installed public vocabulary."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces: dict[str, list[int]] = {}
        # Chunks met before, in order of their hash: hash, check hash, start and number of ids
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _pieces(self, wanted: set[str]) -> dict[str, list[int]]:
        """Printable ASCII pieces go straight to the model, as the byte-level step leaves them as they are."""
        known, tokenize = self.pieces, self.tokenizer.model.tokenize
        found = {w: known[w] for w in wanted if w in known}
        missing = [w for w in wanted if w not in found]
        plain = [w for w in missing if w.isascii() and w.isprintable() and "<|" not in w]
        for w in plain:
            found[w] = [t.id for t in tokenize(w)]
        rest = [w for w in missing if w not in found]
        for low in range(0, len(rest), 20_000):
            part = rest[low : low + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                found[w] = e.ids
        for w in missing[: max(0, PIECE_CACHE - len(known))]:
            known[w] = found[w]
        return found

    def chunks(self, words: list[str]) -> list[list[int]]:
        """Ids of each blank-free chunk."""
        split = [PIECES.findall(w.lower()) if w.isascii() and "<|" not in w else (w,) for w in words]
        ids = self._pieces({p for s in split for p in s})
        return [ids[s[0]] if len(s) == 1 else [i for p in s for i in ids[p]] for s in split]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return [i for ids in self.chunks([w for w in BLANK.split(text) if w]) for i in ids]

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Size and ids, joined, of each of the words. Known words are looked up by two hashes; new ones are kept while there is room."""
        data, bounds = raw_bytes(words)
        key = Words(data, bounds, b"").hash
        check = mix(np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * mix(ranges(np.ones(len(words), np.int64), np.diff(bounds)).astype(np.uint64)), bounds[:-1])) if len(words) else key
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        old = (self.keys[at] == key) & (self.checks[at] == check) if len(self.keys) else np.zeros(len(words), bool)
        new = np.flatnonzero(~old)
        fresh = self.chunks(words.take(pa.array(new)).to_pylist())
        fresh_sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        fresh_ids = np.fromiter(chain.from_iterable(fresh), np.uint32, int(fresh_sizes.sum()))
        fresh_starts = len(self.ids) + np.cumsum(fresh_sizes) - fresh_sizes
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        sizes[old], starts[old] = self.sizes[at[old]], self.starts[at[old]]
        sizes[new], starts[new] = fresh_sizes, fresh_starts
        ids = np.concatenate([self.ids, fresh_ids])
        joined = ids[ranges(starts, sizes)]
        add = new[: max(0, CHUNK_CACHE - len(self.keys))]
        if len(add):
            n = len(add)
            keys = np.concatenate([self.keys, key[add]])
            order = np.argsort(keys, kind="stable")
            first = np.ones(len(order), bool)
            first[1:] = np.diff(keys[order]) != 0
            order = order[first]
            self.keys, self.checks = keys[order], np.concatenate([self.checks, check[add]])[order]
            self.starts = np.concatenate([self.starts, fresh_starts[:n]])[order]
            self.sizes = np.concatenate([self.sizes, fresh_sizes[:n].astype(np.int32)])[order]
            self.ids = ids[: len(self.ids) + int(fresh_sizes[:n].sum())]
        return sizes, joined

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Chunk offsets by text, code of each chunk, ids per code, the codes' strings and all codes' ids, joined."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)  # as the normalizer does; special tokens are found before it
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        bounds = lists.offsets.to_numpy()
        offsets = np.concatenate([[0], np.cumsum(full)])[bounds - bounds[0]]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        sizes, joined = self._table(coded.dictionary)
        return offsets, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, coded.dictionary, joined


def gather(codes: np.ndarray, sizes: np.ndarray, joined: np.ndarray) -> np.ndarray:
    """Ids of a run of chunks."""
    starts = np.cumsum(sizes) - sizes
    return joined[ranges(starts[codes], sizes[codes])]
