"""Token counts by rank-synchronous array merging of byte-level BPE.

Texts are cut into pre-tokens; the distinct ones of a batch that no earlier batch of the task
has met are laid end to end in one ragged numpy array of symbol ids. Each round looks up the
rank of every adjacent pair, takes each sequence's lowest rank (a segmented minimum) and merges
all occurrences of that pair in all sequences at once; rounds go on until no sequence has a
pair left. What survives is counted. Sequences that are done leave the arrays. A sequence of more
than ``LONG_BYTES`` bytes is merged by itself, with its places filed by rank: a round takes the
lowest rank's places only, merges them at once and files the pairs that this makes, so its work
follows the number of places and not that number times the rounds.

The counts are those of the ``tokenizers`` library. Letters, numbers and spaces are what that
library takes for them, of any Unicode version: its classes are read once from a split of all code
points, and texts that hold one of the code points which the regular expressions here class
otherwise are cut by those classes written out. A later merge never yields a pair of lower
rank than the merge that made its symbols (``BpeRanks`` checks that when it loads), so merging
all occurrences of the lowest pair at once gives what one merge at a time gives.

Work is one Arrow pass over the input partitions: no shuffle, memory bounded by a slice of texts
plus a cache of pre-token counts that is emptied at ``CACHE_ENTRIES``.

Defined results: a null text counts as empty; an empty text has 0 bytes and 0 tokens; special
strings inside a text are one token each, as the library does by default; rows are kept as they
are, repeats and null ids included; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed by the byte-level vocabulary format: how texts are cut before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of more characters are not kept in the cache.
CACHE_ENTRIES, CACHE_CHARS = 400_000, 256
SLICE_BYTES = 2_000_000
LONG_BYTES = 1024
CODE_POINTS = 0x110000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in vocabulary files of this kind."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {}, 256
    for b in range(256):
        if b in shown:
            names[b] = chr(b)
        else:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


class BpeRanks:
    """A vocabulary's merges as a sorted array of pair keys with ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._check(spec)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_id = np.array([vocab[s] for s in _byte_symbols()], np.int64)
        self.base = max(vocab.values()) + 1
        left, right, made = (np.array([vocab[s] for s in side], np.int64) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        rank_of = np.full(self.base, -1, np.int64)
        ranks = np.arange(len(pairs))
        if len(np.unique(made)) != len(made):
            raise ValueError("a symbol has two merges; simultaneous merging needs one")
        rank_of[made] = ranks
        if (rank_of[left] >= ranks).any() or (rank_of[right] >= ranks).any():
            raise ValueError("a merge uses a symbol that a later merge makes")
        keys = left * self.base + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], ranks[order], made

    @staticmethod
    def _check(spec: dict) -> None:
        """Refuses files whose settings would change the counts in ways not handled here."""
        cut, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        tokens = [t for t in spec.get("added_tokens", []) if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or (t.get("normalized") and not t.get("special"))]
        set_ = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if not plain or spec.get("normalizer") or tokens or set_:
            raise ValueError("only byte-level vocabularies without normalizer, prefix space or stripping tokens are handled")

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; len(made) where there is none."""
        want = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], len(self.made))

    def count(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out = lengths.copy()
        for i in np.nonzero(lengths > LONG_BYTES)[0]:
            out[i] = self.count_long(words[i])
        live = np.nonzero((lengths > 1) & (lengths <= LONG_BYTES))[0]
        if not len(live):
            return out
        raw = np.frombuffer(b"".join(words[i] for i in live), np.uint8)
        sym, seq = self.byte_id[raw], np.repeat(live, lengths[live])
        none = len(self.made)
        while len(sym) > 1:
            rank = self.pair_ranks(sym[:-1], sym[1:])
            rank[seq[:-1] != seq[1:]] = none
            starts = np.nonzero(np.r_[True, seq[1:] != seq[:-1]])[0]
            low = np.minimum.reduceat(np.r_[rank, none], starts)
            sizes = np.diff(np.r_[starts, len(seq)])
            out[seq[starts]] = sizes
            go = low < none
            if not go.any():
                break
            at = np.nonzero((rank == np.repeat(low, sizes)[:-1]) & (rank < none))[0]
            # equal pairs may overlap (a a a): of a chain keep every second from its left end
            new_chain = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(new_chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.repeat(go, sizes)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        if len(sym):
            starts = np.nonzero(np.r_[True, seq[1:] != seq[:-1]])[0]
            out[seq[starts]] = np.diff(np.r_[starts, len(seq)])
        return out


    def count_long(self, word: bytes) -> int:
        """Surviving symbols of one long sequence; each rank comes up once, in order.

        A merge makes a symbol whose pairs have higher ranks only, so all places of a rank are
        known when it comes up. Places stay filed when their pair is gone and are skipped then.
        """
        sym = self.byte_id[np.frombuffer(word, np.uint8)].copy()
        n, none = len(sym), len(self.made)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        there = np.ones(n, bool)
        filed: dict[int, list[np.ndarray]] = {}
        due: list[int] = []

        def file(at: np.ndarray) -> None:
            """Files the places ``at`` under the rank of the pair that begins there."""
            at = at[(at >= 0) & (at < n)]
            at = at[after[at] < n]
            rank = self.pair_ranks(sym[at], sym[after[at]])
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            first = np.nonzero(np.r_[True, rank[1:] != rank[:-1]])[0] if len(rank) else []
            for r, part in zip(rank[first].tolist(), np.split(at, first[1:]), strict=True) if len(rank) else ():
                if r < none:
                    if r not in filed:
                        heapq.heappush(due, r)
                    filed.setdefault(r, []).append(part)

        file(np.arange(n))
        while due:
            r = heapq.heappop(due)
            at = np.unique(np.concatenate(filed.pop(r)))
            at = at[there[at]]
            at = at[after[at] < n]
            at = at[self.pair_ranks(sym[at], sym[after[at]]) == r]
            if not len(at):
                continue
            chained = np.r_[False, after[at[:-1]] == at[1:]]  # equal pairs may overlap, as above
            first = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            sym[at], there[gone], after[at] = self.made[r], False, after[gone]
            right = after[at]
            before[right[right < n]] = at[right < n]
            file(np.unique(np.r_[at, before[at]]))
        return int(there.sum())


@cache
def library_classes() -> tuple[str, np.ndarray]:
    """(how texts are cut, with the library's own classes written out; a bit for each code point
    that PRE_TOKEN classes otherwise)."""
    from tokenizers import Regex, pre_tokenizers

    codes = np.r_[0:0xD800, 0xE000:CODE_POINTS]
    every = "".join(map(chr, codes.tolist()))
    odd, members = np.zeros(CODE_POINTS, bool), []
    for kind in (r"\p{L}+", r"\p{N}+", r"\s+"):
        theirs, ours = np.ones(len(codes), bool), np.zeros(len(codes), bool)
        for _, (begin, end) in pre_tokenizers.Split(Regex(kind), "removed").pre_tokenize_str(every):
            theirs[begin:end] = False
        for m in regex.finditer(kind, every):
            ours[m.start() : m.end()] = True
        odd[codes[theirs != ours]] = True
        mine = codes[theirs]
        first = np.nonzero(np.r_[True, np.diff(mine) != 1])[0]
        last = np.r_[first[1:], len(mine)] - 1
        members.append("".join(f"\\U{x:08x}-\\U{y:08x}" for x, y in zip(mine[first].tolist(), mine[last].tolist(), strict=True)))
    letter, number, space = members
    cut = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    return cut, np.packbits(odd)


def _counter(path: str, classes: tuple[str, np.ndarray] | None = None):
    """A function from a list of texts to their token counts, with a bounded cache."""
    ranks = BpeRanks(path)
    exact, bits = classes or library_classes()
    odd, exact_cut = np.unpackbits(bits).astype(bool), None

    def cutter(text: str):
        nonlocal exact_cut
        if text.isascii() or not odd[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any():
            return cut_at
        exact_cut = exact_cut or regex.compile(exact)
        return exact_cut

    cut_at = regex.compile(PRE_TOKEN)
    special = regex.compile("|".join(regex.escape(s) for s in ranks.specials)) if ranks.specials else None
    cache: dict[str, int] = {}

    def counts(texts: list[str]) -> list[int]:
        cut, extra = [], []
        for text in texts:
            found, words_in = len(special.findall(text)) if special else 0, cutter(text).findall
            extra.append(found)
            cut.append([w for part in special.split(text) for w in words_in(part)] if found else words_in(text))
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        fresh = list({w for ws in cut for w in ws if w not in cache})
        now = dict(zip(fresh, ranks.count([w.encode("utf-8") for w in fresh]).tolist(), strict=True))
        cache.update((w, n) for w, n in now.items() if len(w) <= CACHE_CHARS)
        of = cache.__getitem__ if all(w in cache for w in fresh) else lambda w: now[w] if w in now else cache[w]
        return [n + sum(map(of, ws)) for n, ws in zip(extra, cut, strict=True)]

    return counts


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) -> id, n_bytes, n_tokens, over_limit, with the byte-level BPE file ``tokenizer``.

    The path must exist on every executor, as a vocabulary installed with a Python package does.
    """
    kind = docs.schema[id_col].dataType
    name, classes = docs.select(F.col(id_col)).schema[0].name, library_classes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            counts = counts or _counter(tokenizer, classes)
            sizes = [0 if n is None else n for n in pc.binary_length(batch.column(1)).to_pylist()]
            tokens, begin, held = [], 0, 0
            for i, n in enumerate(sizes):
                held += n
                if held >= SLICE_BYTES or i + 1 == len(sizes):
                    tokens += counts([t or "" for t in batch.column(1).slice(begin, i + 1 - begin).to_pylist()])
                    begin, held = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[name, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{name}` {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
