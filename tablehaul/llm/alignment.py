"""How two tokenizers cut the same text: aligned groups of tokens, and how usual each pair of tokens is.

Both encode a text; places where a token of each ends cut them into groups, and every token of one side of a
group is linked with every one of the other. A pair of ids counts the documents that hold it linked.

1. First pass: texts are aligned, and each task counts the documents of its distinct pairs. Texts fall into chunks at places
   where both sides always have a boundary; a worker aligns equal chunks once.
2. Distinct pairs are dealt into segments by their A id, and each segment gets a minimal perfect hash: bit
   arrays in levels, on each of which the keys that are alone at their place stay; a key's number is the rank of its
   bit. The keys lie in an array by number, so that a key of no segment is told from one that is there.
3. Counts become dense vectors indexed by the hash, for groups of tasks, and are added up as a tree.
4. Second pass: texts are aligned again and look their pairs' counts up, in tables sent to all tasks. Tables of more than
   ``ROUND_BYTES`` are sent in several rounds, each of whole segments, and the documents' sums are added;
   so what is broadcast is bounded, whatever the number of pairs.

Defined results: null and empty texts, and texts that either side does not give back byte by byte, have no tokens; the
empty string stands for their groups; repeated rows count as documents of their own; an empty table gives no rows;
texts are encoded whole, and pairs of a large group are made in bounded pieces.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablehaul.llm.shared import slices, stored, table, worker_cache
from tablehaul.llm.words import mix

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text encoded at once; pairs of tokens made at once, and held by a task before it writes them.
SLICE, PAIRS, HELD = 1 << 20, 1 << 20, 1 << 20
#: Pairs of a segment, about (an A id's pairs stay together, at most as many as B has ids).
SEGMENT = 1 << 16
#: Bytes of tables sent to all tasks at once.
ROUND_BYTES = 64 << 20
#: Vectors added in one task.
TREE = 8


class Tokens:
    """Both tokenizers, loaded once in each worker."""

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Tokens:
        kept, key = worker_cache(), f"tokens {a_path} {b_path}"
        if key not in kept:
            kept[key] = cls(a_path, b_path)
            kept[f"chunks {a_path} {b_path}"] = Chunks(kept[key])
        return kept[key]

    @classmethod
    def chunks(cls, a_path: str, b_path: str) -> Chunks:
        cls.of(a_path, b_path)
        return worker_cache()[f"chunks {a_path} {b_path}"]

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        vocabulary = json.load(open(a_path, encoding="utf-8"))["model"]["vocab"]
        letters = _byte_letters()
        a_bytes = {i: bytes([letters[c] for c in token]) for token, i in vocabulary.items() if all(c in letters for c in token)}
        self.a_size = max(vocabulary.values()) + 1
        # The file's ids are in the order of its merges, so they are ranks; the special token, its last, isn't among them.
        ranks = {raw: i for i, raw in a_bytes.items() if i < self.a_size - 1}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_size = self.b.get_piece_size()
        self.a_text = pa.array([a_bytes.get(i, b"") for i in range(self.a_size)], pa.large_binary())
        if any(x != "▁" and y == "▁" for i in range(self.b_size) for x, y in pairwise(self.b.id_to_piece(i))):
            raise ValueError(f"{b_path} has pieces with a blank after another character")
        self.b_text = pa.array([_piece_bytes(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.b_size)], pa.large_binary())
        numbers = [str(i).encode() for i in range(max(self.a_size, self.b_size))]
        ends = ((b",", self.a_size), (b"|", self.a_size), (b",", self.b_size), (b";", self.b_size))
        self.written = pa.array([numbers[i] + end for end, size in ends for i in range(size)], pa.large_binary())

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[list[int]]]:
        return [self.a.encode_to_numpy(" " + t) for t in texts], self.b.encode(texts, num_threads=1)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, others from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


@dataclass
class Aligned:
    """The alignment of a slice of texts. Rows that hold no tokens have zeros."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    row: np.ndarray  # of each group
    a: np.ndarray  # ids of A in order, and the group of each
    a_group: np.ndarray
    b: np.ndarray
    b_group: np.ndarray

    def written(self, tokens: Tokens) -> list[bytes]:
        """The groups of each row as text; empty without tokens."""
        last_a = np.append(self.a_group[1:] != self.a_group[:-1], True)[: len(self.a)]
        last_b = np.append(self.b_group[1:] != self.b_group[:-1], True)[: len(self.b)]
        code = np.concatenate([self.a + last_a * tokens.a_size, 2 * tokens.a_size + self.b + last_b * tokens.b_size])
        group = np.concatenate([2 * self.a_group, 2 * self.b_group + 1])
        order = np.argsort(group, kind="stable")
        text = tokens.written.take(pa.array(code[order]))
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        raw = memoryview(text.buffers()[2] or b"")
        ends = at[np.append(0, np.cumsum(self.n_a + self.n_b))]
        return [bytes(raw[s : e - 1]) if e > s else b"" for s, e in zip(ends.tolist(), ends[1:].tolist())]

    def pairs(self, b_size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, pair (a * b_size + b) and number of links, in pieces; a row's pair may be in several."""
        a_group, a, a_times = _counted(self.a_group, self.a)
        b_group, b, b_times = _counted(self.b_group, self.b)
        begin = np.searchsorted(b_group, a_group)
        size = np.searchsorted(b_group, a_group, "right") - begin  # of B's tokens that an A token meets
        upto = np.append(0, np.cumsum(size))
        at = 0
        while at < len(a):
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS, "right")) - 1)
            left = np.repeat(np.arange(at, stop), size[at:stop])
            right = np.arange(upto[stop] - upto[at]) - np.repeat(upto[at:stop] - upto[at], size[at:stop]) + begin[left]
            yield self.row[a_group[left]], a[left] * b_size + b[right], a_times[left] * b_times[right]
            at = stop


def _counted(group: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each group's distinct tokens and how often each is there."""
    code, times = np.unique((group.astype(np.int64) << 20) | token, return_counts=True)
    return code >> 20, code & ((1 << 20) - 1), times


def _joined(text: pa.Array, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat ids, how many each row has, where each token ends, and the bytes of all."""
    count = np.array([len(i) for i in ids], np.int64)
    if ids and isinstance(ids[0], np.ndarray):
        flat = np.concatenate(ids).astype(np.int64)
    else:
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum()))
    taken = text.take(pa.array(flat))
    at = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(flat) + 1]
    raw = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[at[0] : at[-1]] if len(flat) else np.zeros(0, np.uint8)
    return flat, count, at[1:] - at[0] if len(flat) else np.zeros(0, np.int64), raw


def _same(raw: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, wanted_sizes: np.ndarray) -> np.ndarray:
    """Which rows are equal byte by byte."""
    ends, wanted_ends = np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(wanted_sizes))
    if len(raw) == len(wanted) and (sizes == wanted_sizes).all() and (raw == wanted).all():
        return np.ones(len(sizes), bool)
    return np.array([
        sizes[i] == wanted_sizes[i] and bool((raw[ends[i] : ends[i + 1]] == wanted[wanted_ends[i] : wanted_ends[i + 1]]).all()) for i in range(len(sizes))
    ], bool)


def align(tokens: Tokens, texts: list[str | None], joined: bool = False) -> Aligned:
    """joined: the texts may be encoded as one, with blanks between, as each begins and ends at a cut then."""
    rows = len(texts)
    given = np.flatnonzero([bool(t) for t in texts])
    wanted = [(" " + texts[i]).encode() for i in given]
    wanted_sizes = np.array([len(w) for w in wanted], np.int64)
    row_end = np.cumsum(wanted_sizes)
    raw = np.frombuffer(b"".join(wanted), np.uint8)
    joined = joined and len(given) > 0
    step = JOINED if joined else 1
    a_ids, b_ids = tokens.encode([" ".join([texts[i] for i in given[at : at + step]]) for at in range(0, len(given), step)])
    a, a_count, a_end, a_raw = _joined(tokens.a_text, a_ids)
    b, b_count, b_end, b_raw = _joined(tokens.b_text, b_ids)
    if joined:
        if len(a_raw) != len(raw) or len(b_raw) != len(raw) or (a_raw != raw).any() or (b_raw != raw).any():
            return align(tokens, texts)
        a_count, b_count = (np.bincount(np.searchsorted(row_end, end), minlength=len(given)) for end in (a_end, b_end))
    else:
        last = lambda end, count: np.diff(np.append(0, np.append(0, end)[np.cumsum(count)]))
        good = _same(a_raw, last(a_end, a_count), raw, wanted_sizes) & _same(b_raw, last(b_end, b_count), raw, wanted_sizes)
        if not good.all():
            kept = [texts[i] if ok else None for i, ok in zip(given, good)]
            return _placed(align(tokens, kept) if len(given) else None, given, rows)
    ends_b = np.zeros(len(raw) + 1, bool)
    ends_b[b_end] = True
    cuts = a_end[ends_b[a_end]]
    cuts = cuts[np.append(True, cuts[1:] != cuts[:-1])[: len(cuts)]]
    row_of_cut = np.searchsorted(row_end, cuts)
    a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
    links = np.bincount(a_group, minlength=len(cuts)) * np.bincount(b_group, minlength=len(cuts))
    found = Aligned(
        a_count, b_count, np.bincount(row_of_cut, minlength=len(given)), np.bincount(row_of_cut, links, minlength=len(given)).astype(np.int64),
        row_of_cut, a, a_group, b, b_group,
    )
    return _placed(found, given, rows)


def _placed(found: Aligned | None, at: np.ndarray, rows: int) -> Aligned:
    """An alignment of some rows as one of all."""
    none = np.zeros(0, np.int64)
    if found is None:
        return Aligned(*(np.zeros(rows, np.int64) for _ in range(4)), none, none, none, none, none)

    def spread(x: np.ndarray) -> np.ndarray:
        out = np.zeros(rows, np.int64)
        out[at] = x
        return out

    sums = (spread(x) for x in (found.n_a, found.n_b, found.n_groups, found.n_links))
    return Aligned(*sums, at[found.row] if len(found.row) else none, found.a, found.a_group, found.b, found.b_group)


def by_row(align_pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and links, each pair of a row once."""
    row, pair, links = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def merge() -> None:
        nonlocal row, pair, links, held
        code = np.concatenate([row * width + pair, *(r * width + p for r, p, _ in parts)])
        total = np.concatenate([links, *(n for _, _, n in parts)])
        code, inverse = np.unique(code, return_inverse=True)
        links = np.bincount(inverse, total, minlength=len(code)).astype(np.int64)
        row, pair = code // width, code % width
        parts.clear()
        held = 0

    for part in align_pairs:
        parts.append(part)
        held += len(part[0])
        if held > 2 * PAIRS:
            merge()
    merge()
    return row, pair, links


#: A place where both sides always have a boundary: a space between a character other than a space and one that isn't blank.
#: A's pattern begins a token there, and none of B's pieces holds a blank after another character (checked on loading).
_CUT = re.compile(r"(?<=[^ ]) (?=\S)")
#: Characters that are cut into chunks at once; chunks a worker remembers, and the bytes of them.
PIECE, REMEMBERED, REMEMBERED_BYTES = 1 << 20, 1 << 19, 32 << 20
#: New chunks that are encoded as one text.
JOINED = 256


class Chunks:
    """Alignments of the chunks between cuts, each made once as long as a worker remembers it."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.written: list[bytes] = []
        self.bytes = 0
        self.sums = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links, 1 if all bytes are given back
        self.first = np.zeros(1, np.int64)  # where each chunk's pairs begin
        self.pair = np.zeros(0, np.int64)
        self.links = np.zeros(0, np.int64)

    def numbers(self, chunks: list[str]) -> np.ndarray:
        if len(self.ids) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        new = [c for c in dict.fromkeys(chunks) if c not in self.ids]
        # Chunks at the ends of texts may have blanks there, and U+2581 is not given back: each of these by itself.
        plain = [not (c[0].isspace() or c[-1].isspace() or "▁" in c) for c in new]
        self._learn([c for c, p in zip(new, plain) if p], True)
        self._learn([c for c, p in zip(new, plain) if not p], False)
        return np.fromiter(map(self.ids.__getitem__, chunks), np.int64, len(chunks))

    def _learn(self, new: list[str], joined: bool) -> None:
        if new:
            found = align(self.tokens, new, joined)
            row, pair, links = by_row(found.pairs(self.tokens.b_size), self.tokens.a_size * self.tokens.b_size)
            new_sums = np.column_stack([found.n_a, found.n_b, found.n_groups, found.n_links, found.n_a > 0])
            self.sums = np.concatenate([self.sums, new_sums])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(row, minlength=len(new)))])
            self.pair, self.links = np.concatenate([self.pair, pair]), np.concatenate([self.links, links])
            self.written += found.written(self.tokens)
            self.bytes += sum(map(len, new))
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new))))


@dataclass
class Rows:
    """What is asked for of a slice of texts; pairs are of the rows that hold tokens, each pair of a row once."""

    sums: np.ndarray  # a row for each text: tokens of A, of B, groups, links
    digests: list[str]
    row: np.ndarray
    pair: np.ndarray
    links: np.ndarray


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Rows and parts of their texts, cut at cuts only, about ``PIECE`` characters at once."""
    held: list[tuple[int, str]] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            cut = _CUT.search(text, at + PIECE) if len(text) - at > PIECE else None
            part = text[at : cut.start()] if cut else text[at:]
            at = cut.end() if cut else len(text)
            held.append((row, part))
            size += len(part)
            if size > PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def align_rows(chunks: Chunks, texts: list[str | None]) -> Rows:
    rows = len(texts)
    sums, bad = np.zeros((rows, 4), np.int64), np.zeros(rows, bool)
    hashes: dict[int, Any] = {}

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for held in _pieces(texts):
            parts = [_CUT.split(part) for _, part in held]
            number = chunks.numbers(list(chain.from_iterable(parts)))
            count = np.array([len(p) for p in parts])
            row = np.repeat(np.array([r for r, _ in held]), count)
            found = chunks.sums[number]
            for column in range(4):
                sums[:, column] += np.bincount(row, found[:, column], minlength=rows).astype(np.int64)
            bad[row[found[:, 4] == 0]] = True
            ends = np.cumsum(count)
            for (r, _), begin, end in zip(held, (ends - count).tolist(), ends.tolist()):
                text = b";".join([chunks.written[n] for n in number[begin:end].tolist()])
                if r in hashes:
                    hashes[r].update(b";")
                hashes.setdefault(r, hashlib.sha256()).update(text)
            code, times = np.unique(row * np.int64(len(chunks.sums)) + number, return_counts=True)
            own, one = code // len(chunks.sums), code % len(chunks.sums)
            size = chunks.first[one + 1] - chunks.first[one]
            at = np.repeat(chunks.first[one] - np.append(0, np.cumsum(size[:-1])), size) + np.arange(size.sum())
            yield np.repeat(own, size), chunks.pair[at], chunks.links[at] * np.repeat(times, size)

    row, pair, links = by_row(pairs(), chunks.tokens.a_size * chunks.tokens.b_size)
    sums[bad] = 0
    kept = ~bad[row]
    digests = ["" if bad[r] or r not in hashes else hashes[r].hexdigest() for r in range(rows)]
    return Rows(sums, digests, row[kept], pair[kept], links[kept])


# Minimal perfect hashing

_LEVELS, _ROOM = 32, 2.0


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    spread = mix(keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return (spread % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Numbers 0 to n - 1 for n keys; any other key gets some number or -1."""

    bits: list[np.ndarray]  # one array of bytes for each level
    sizes: list[int]
    rank: np.ndarray  # set bits before each byte of all levels

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct. On each level the keys alone at their place stay; the others go on to the next."""
        bits, sizes, left = [], [], keys
        while len(left):
            if len(bits) == _LEVELS:
                raise ValueError("keys are not distinct")
            size = max(8, -(-int(_ROOM * len(left)) // 8) * 8)
            place = _place(left, len(bits), size)
            alone = np.bincount(place, minlength=size) == 1
            bits.append(np.packbits(alone))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(bits, sizes, _ranks(bits))

    def number(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        left, before = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            place = _place(keys[left], level, size)
            byte, within = place >> 3, place & 7
            value = self.bits[level][byte]
            here = (value >> (7 - within).astype(np.uint8)) & 1 == 1
            earlier = np.bitwise_count(value[here] >> (8 - within[here]).astype(np.uint8)).astype(np.int64)
            out[left[here]] = self.rank[before + byte[here]] + earlier
            left, before = left[~here], before + size // 8
        return out

    def packed(self) -> tuple[bytes, list[int]]:
        return b"".join(b.tobytes() for b in self.bits), self.sizes

    @classmethod
    def unpacked(cls, raw: bytes, sizes: list[int]) -> PerfectHash:
        at = np.append(0, np.cumsum(sizes)) // 8
        flat = np.frombuffer(raw, np.uint8)
        bits = [flat[s:e] for s, e in zip(at.tolist(), at[1:].tolist())]
        return cls(bits, list(sizes), _ranks(bits))


def _ranks(bits: list[np.ndarray]) -> np.ndarray:
    counts = np.bitwise_count(np.concatenate([*bits, np.zeros(0, np.uint8)])).astype(np.int64)
    return np.append(0, np.cumsum(counts)).astype(np.uint32)


class Counts:
    """Segments of counted pairs, as tasks look them up."""

    def __init__(self, rows: list, n_segments: int, b_size: int):
        self.n_segments, self.b_size = n_segments, b_size
        self.segments = {r["seg"]: r for r in rows}
        self.found: dict[int, tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"found": {}}

    def _segment(self, seg: int) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
        if seg not in self.found:
            r = self.segments[seg]
            keys, counts = np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.int64)
            a = keys // self.b_size
            best = np.zeros(int(a.max()) + 1, np.int64)
            np.maximum.at(best, a, counts)
            self.found[seg] = PerfectHash.unpacked(r["bits"], r["sizes"]), keys, counts, best
        return self.found[seg]

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each pair is in these segments, its count, and whether that is the highest of its A id."""
        known, count, top = np.zeros(len(pairs), bool), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        seg = segment_of(pairs // self.b_size, self.n_segments)
        order = np.argsort(seg, kind="stable")
        ends = np.flatnonzero(np.append(seg[order][1:] != seg[order][:-1], True)) + 1 if len(seg) else []
        begin = 0
        for end in ends:
            at, begin = order[begin:end], int(end)
            if int(seg[at[0]]) not in self.segments:
                continue
            hashed, keys, counts, best = self._segment(int(seg[at[0]]))
            number = hashed.number(pairs[at])
            verified = number >= 0
            verified[verified] = keys[number[verified]] == pairs[at][verified]
            if not verified.all():
                raise ValueError("a pair of the second pass that the first did not count")
            known[at], count[at] = True, counts[number]
            top[at] = counts[number] == best[pairs[at] // self.b_size]
        return known, count, top


def segment_of(a: np.ndarray, n_segments: int) -> np.ndarray:
    return (mix(a.astype(np.uint64) + np.uint64(1)) % np.uint64(n_segments)).astype(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def pair_counts(docs: DataFrame, paths: tuple[str, str]) -> tuple[DataFrame, int]:
    """docs: text. seg, keys, counts, bits, sizes: the tables of all pairs, one row a segment; and how many segments there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunks, part = Tokens.chunks(*paths), TaskContext.get().partitionId()
        keys, totals = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for at in range(0, len(keys), 1 << 16):
                k, n = keys[at : at + (1 << 16)], totals[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(n)], names=["part", "pair", "n"])

        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                new, times = np.unique(align_rows(chunks, piece.column(0).to_pylist()).pair, return_counts=True)
                keys, inverse = np.unique(np.concatenate([keys, new]), return_inverse=True)
                totals = np.bincount(inverse, np.concatenate([totals, times]), minlength=len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield from out()
                    keys, totals = keys[:0], totals[:0]
        yield from out()

    spark = docs.sparkSession
    sparse = stored(docs.select("text").mapInArrow(count, "part int, pair long, n long"), "pairs-of-tasks")
    distinct = stored(sparse.select("pair").distinct(), "pairs")
    n_segments = max(1, -(-distinct.count() // SEGMENT))
    b_size = Tokens.of(*paths).b_size

    @F.arrow_udf("int")
    def segment(pair: pa.Array) -> pa.Array:
        return pa.array(segment_of(pair.to_numpy(zero_copy_only=False) // b_size, n_segments).astype(np.int32))

    def hashed(group: pa.Table) -> pa.Table:
        keys = group.column("pair").to_numpy()
        of = PerfectHash.build(keys)
        by_number = np.empty_like(keys)
        by_number[of.number(keys)] = keys
        bits, sizes = of.packed()
        return pa.table({
            "seg": group.column("seg")[:1], "keys": pa.array([by_number.tobytes()], pa.binary()), "bits": pa.array([bits], pa.binary()),
            "sizes": pa.array([sizes], pa.list_(pa.int64())),
        })

    tables = distinct.withColumn("seg", segment("pair")).groupBy("seg").applyInArrow(hashed, "seg int, keys binary, bits binary, sizes array<long>")
    tables = stored(tables, "pairs-hashed")
    # Dense vectors of a segment, one for each TREE tasks, then added by groups until one is left.
    parts = (sparse.agg(F.max("part")).first()[0] or 0) // TREE + 1
    dealt = sparse.select(segment("pair").alias("seg"), F.floor(F.col("part") / TREE).cast("int").alias("salt"), "pair", "n")
    repeated = tables.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def dense(rows: pa.Table, of: pa.Table) -> pa.Table:
        if not rows.num_rows or not of.num_rows:
            return pa.table({"seg": pa.array([], pa.int32()), "salt": pa.array([], pa.int32()), "vector": pa.array([], pa.binary())})
        found = PerfectHash.unpacked(of.column("bits")[0].as_py(), of.column("sizes")[0].as_py())
        vector = np.zeros(len(of.column("keys")[0].as_py()) // 8, np.int64)
        np.add.at(vector, found.number(rows.column("pair").to_numpy()), rows.column("n").to_numpy())
        return pa.table({"seg": of.column("seg")[:1], "salt": of.column("salt")[:1], "vector": pa.array([vector.tobytes()], pa.binary())})

    def added(group: pa.Table) -> pa.Table:
        total = None
        for vector in group.column("vector"):
            more = np.frombuffer(vector.as_buffer(), np.int64)
            total = more.copy() if total is None else np.add(total, more, out=total)
        return pa.table({"seg": group.column("seg")[:1], "salt": group.column("salt")[:1], "vector": pa.array([total.tobytes()], pa.binary())})

    shape = "seg int, salt int, vector binary"
    vectors = stored(dealt.groupBy("seg", "salt").cogroup(repeated.groupBy("seg", "salt")).applyInArrow(dense, shape), "pairs-vectors")
    while parts > 1:
        parts = -(-parts // TREE)
        vectors = vectors.withColumn("salt", F.floor(F.col("salt") / TREE).cast("int")).groupBy("seg", "salt").applyInArrow(added, shape)
        vectors = stored(vectors, "pairs-vectors")
    return stored(tables.join(vectors.select("seg", F.col("vector").alias("counts")), "seg"), "pairs-counted"), n_segments


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _looked_up(docs: DataFrame, paths: tuple[str, str], counts: Counts) -> DataFrame:
    """The second pass, as far as the segments of ``counts`` go."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, of = Tokens.chunks(*paths), sent.value
        for batch in batches:
            for piece in slices(batch, "text", SLICE):
                found = align_rows(chunks, piece.column(1).to_pylist())
                _, count, top = of.look_up(found.pair)
                sums = [np.zeros(piece.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], found.row[top], found.links[top])
                np.add.at(sums[1], found.row, found.links * count)
                columns = [pa.array(c) for c in (*np.ascontiguousarray(found.sums.T), *sums)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns, pa.array(found.digests, pa.string())], schema=shape)

    names = [c.split()[0] for c in _RESULT.split(", ")]
    shape = pa.schema([(n, pa.string() if n == "groups_sha256" else pa.int64()) for n in names])
    return docs.mapInArrow(run, _RESULT)


def aligned(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", round_bytes: int = ROUND_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row."""
    docs = _texts(docs, id_col, text_col)
    tables, n_segments = pair_counts(docs, paths)
    b_size = Tokens.of(*paths).b_size
    size = F.octet_length("keys") + F.octet_length("counts") + 2 * F.octet_length("bits")
    rounds, held = [[]], 0
    for seg, n in sorted(tables.select("seg", size).collect()):
        if rounds[-1] and held + n > round_bytes:
            rounds.append([])
            held = 0
        rounds[-1].append(seg)
        held += n
    parts = [_looked_up(docs, paths, Counts(tables.where(F.col("seg").isin(r)).collect(), n_segments, b_size)) for r in rounds]
    if len(parts) == 1:
        return parts[0]
    # Every round gives every row; equal rows are one here, with the number of them, and are as many again in the end.
    same = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    total = stored(parts[0].withColumn("first", F.lit(1)), "pairs-round")
    for part in parts[1:]:
        total = total.unionByName(stored(part.withColumn("first", F.lit(0)), "pairs-round"))
    summed = total.groupBy(*same).agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum", "first")))
    whole = summed.select(*same, *((F.col(c) / F.col("first")).cast("long").alias(c) for c in ("n_best", "count_sum")), F.explode(F.sequence(F.lit(1), "first")))
    return whole.select([c.split()[0] for c in _RESULT.split(", ")])


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return str(public_tokenizers.path(A_FILE)), str(public_tokenizers.path(B_FILE))


def op12_perfect_hash_alignment(spark, sf_dir):
    return aligned(table(spark, sf_dir, "documents"), default_paths())
