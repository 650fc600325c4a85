"""Byte-level BPE: encoding by longest matches and backtracking, and decoding."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, spread, spread_codes, table

_SPACE, _SOLID = (rf"[{x}\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]" for x in ("", "^"))  # Arrow's \s is of ASCII only
#: A place where cutting a text before a single blank could change how the pattern below matches.
_UNSAFE = f"{_SPACE} (?:{_SPACE}|$)"
_CUT = re.compile(r"(?<=\S) (?=\S)")


class BytePairEncoder:
    """Exact byte-pair merges of one piece in linear time.

    ``ranks`` maps token bytes to merge ranks, which are the ids. Bytes become Latin-1 characters, so an Aho-Corasick
    automaton over the vocabulary gives the tokens that start at each position; the longest comes first. A token is
    taken if it may stand after its predecessor, that is, if merging the two by rank never crosses the border between
    them; this test is memoised by the pair. Where no token fits, the predecessor is taken back, and the position is
    marked so that it is never tried again. A piece thus visits each position and token length a bounded number of times.
    encode_all() takes these steps for many short pieces at once, as arrays, with a trie in place of the automaton.
    """

    PAIRS, LONG = 1 << 17, 256

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.bytes[k] = token
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(k, k) for k in range(len(self.bytes))]
        self.fits: dict[tuple[int, int], bool] = {}
        for k, token in enumerate(self.bytes):  # in order of rank: the halves of each token are known before it
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None and a < k and b < k and self._compatible(a, b):
                    self.merged[a, b], self.parts[k] = k, (a, b)
                    break
        self.shorter = [-1] * len(self.bytes)  # the longest token that is a proper prefix
        for k, token in enumerate(self.bytes):
            self.shorter[k] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), -1)
        self.find = ahocorasick.Automaton()
        for token, k in ranks.items():
            self.find.add_word(token.decode("latin-1"), k)
        self.find.make_automaton()
        self.size_of, self.shorter_of = np.array([len(x) for x in self.bytes], np.int64), np.array(self.shorter, np.int64)
        self.halves = np.array(self.parts, np.int64)
        keys = np.array([a << 32 | b for a, b in self.merged], np.int64)
        order = np.argsort(keys)
        self.merge_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.merge_ids = np.append(np.array(list(self.merged.values()), np.int64)[order], 1 << 62)
        self.memo = np.full(self.PAIRS, -1, np.int64)  # a pair of tokens and, as its lowest bit, whether they are compatible
        nodes = dict.fromkeys(token[:n] for token in ranks for n in range(len(token)))
        self.inner = len(nodes)  # nodes with children come first, the root before all
        nodes = {x: i for i, x in enumerate(dict.fromkeys([*nodes, *ranks]))}
        steps = np.array([nodes[x[:-1]] << 8 | x[-1] for x in nodes if x], np.int64)
        order = np.argsort(steps)
        self.steps, self.step_to = np.append(steps[order], np.iinfo(np.int64).max), np.append(order + 1, -1)  # the root is node 0
        self.token_of = np.full(len(nodes), -1, np.int64)
        self.token_of[[nodes[x] for x in ranks]] = list(ranks.values())

    def _compatible(self, a: int, b: int) -> bool:
        """Undo merges at the border of two tokens, latest first; false if an earlier merge would have joined across it."""
        bound = 1 << 62
        while True:
            if self.merged.get((a, b), bound) < bound:
                return False
            left, right = self.parts[a], self.parts[b]
            if a > b and left[1] != a or right[0] == b:
                if left[1] == a:
                    return True
                bound, a = a, left[1]
            else:
                bound, b = b + 1, right[0]

    def compatible(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        size = len(piece)
        longest = [-1] * size
        for end, k in self.find.iter(piece.decode("latin-1")):
            start = end + 1 - len(self.bytes[k])
            if longest[start] < 0 or len(self.bytes[k]) > len(self.bytes[longest[start]]):
                longest[start] = k
        open_at = bytearray(b"\x01" * (size + 1))
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < size:
            while token >= 0:
                end = at + len(self.bytes[token])
                if open_at[end] and (not ids or self.compatible(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = longest[at] if at < size else -1
            elif ids:
                open_at[at] = 0
                token = ids.pop()
                at -= len(self.bytes[token])
            else:
                raise ValueError("the vocabulary lacks a byte of the text")
        return ids

    def _longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token from each place that ends by its end, -1 for none."""
        found, who, node = np.full(len(at), -1, np.int64), np.arange(len(at)), np.zeros(len(at), np.int64)
        while len(who):
            step = node << 8 | data[at]
            spot = np.searchsorted(self.steps, step)
            node = np.where(self.steps[spot] == step, self.step_to[spot], -1)
            token = np.where(node >= 0, self.token_of[node], -1)
            found[who[token >= 0]] = token[token >= 0]
            at = at + 1
            on = np.flatnonzero((node >= 0) & (node < self.inner) & (at < end))
            who, node, at, end = who[on], node[on], at[on], end[on]
        return found

    def _compatible_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """_compatible() of each pair."""
        out, who, bound = np.zeros(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 62)
        while len(who):
            key = a << 32 | b
            at = np.searchsorted(self.merge_keys, key)
            crossed = (self.merge_keys[at] == key) & (self.merge_ids[at] < bound)
            inner, outer = self.halves[a, 1], self.halves[b, 0]
            first = (a > b) & (inner != a) | (outer == b)
            done = first & (inner == a)
            out[who[done & ~crossed]] = True
            bound, a, b = np.where(first, a, b + 1), np.where(first, inner, a), np.where(first, b, outer)
            on = np.flatnonzero(~(crossed | done))
            who, bound, a, b = who[on], bound[on], a[on], b[on]
        return out

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of each pair; a place of the memo has the last pair that fell on it."""
        key = a << 32 | b
        place = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % self.PAIRS
        known = self.memo[place]
        out = (known & 1).astype(bool)
        if len(new := np.flatnonzero(known >> 1 != key)):
            pairs, back = np.unique(key[new], return_inverse=True)
            out[new] = self._compatible_all(pairs >> 32, pairs & 0xFFFFFFFF)[back]
            self.memo[place[new]] = key[new] << 1 | out[new]
        return out

    def encode_all(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, piece k being the bytes from edges[k] to edges[k + 1], and how many each has."""
        ids, counts = np.zeros(len(data), "<u4"), np.zeros(len(edges) - 1, np.int64)  # a piece's ids begin at its first byte's place
        sizes = np.diff(edges)
        for k in np.flatnonzero(sizes > self.LONG).tolist():
            got = self.encode(data[edges[k] : edges[k + 1]].tobytes())
            ids[edges[k] : edges[k] + len(got)] = got
            counts[k] = len(got)
        open_at = np.ones(len(data) + 1, bool)
        who = np.flatnonzero((sizes > 0) & (sizes <= self.LONG))
        at, end, top = edges[who], edges[who + 1], edges[who]  # top: where the piece's next id goes
        token, last = self._longest(data, at, end), np.full(len(who), -1, np.int64)
        while len(who):
            to = at + np.where(token >= 0, self.size_of[token], 0)
            fits = (token >= 0) & open_at[to]
            asked = np.flatnonzero(fits & (last >= 0))
            fits[asked] = self._fit_all(last[asked], token[asked])
            ids[top[fits]] = token[fits]
            at, top, last = np.where(fits, to, at), top + fits, np.where(fits, token, last)
            ended = fits & (at == end)
            counts[who[ended]] = (top - edges[who])[ended]
            go = np.flatnonzero(fits & ~ended)
            no = np.flatnonzero(~fits)
            token[go] = self._longest(data, at[go], end[go])
            token[no] = np.where(token[no] >= 0, self.shorter_of[token[no]], -1)
            if len(back := no[token[no] < 0]):
                first = edges[who[back]]
                if (top[back] == first).any():
                    raise ValueError("the vocabulary lacks a byte of the text")
                open_at[at[back]] = False
                top[back] -= 1
                token[back] = last[back]
                at[back] -= self.size_of[token[back]]
                last[back] = np.where(top[back] > first, ids[top[back] - 1].astype(np.int64), -1)
            if ended.any():
                on = np.flatnonzero(~ended)
                who, at, end, top, token, last = (x[on] for x in (who, at, end, top, token, last))
        return spread(ids, edges[:-1], counts), counts


class Recent:
    """Values of recent keys, about ``most`` of them: two dictionaries, of which the older is dropped when the newer is full."""

    def __init__(self, most: int) -> None:
        self.half, self.new, self.old = most // 2, {}, {}

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def fill(self, keys: list, make) -> list:
        """Values of keys; make(list of keys) gives those that aren't known."""
        out = list(map(self.new.get, keys))
        if None in out:
            wanted: dict = {}
            for i, value in enumerate(out):
                if value is None:
                    key = keys[i]
                    if (value := self.old.get(key)) is None:
                        wanted.setdefault(key, []).append(i)
                    else:
                        self.put(key, value)
                        out[i] = value
            for (key, at), value in zip(wanted.items(), make(list(wanted)), strict=True):
                if len(key) < 64:
                    self.put(key, value)
                for i in at:
                    out[i] = value
        return out


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    Texts are cut before single blanks, which never changes what the pattern matches; texts where it could are matched
    whole, very long ones in parts. Arrow finds the distinct cuts of a MB of texts, the pattern their pieces; each distinct
    piece is encoded once. Pieces of recent cuts that the pattern takes one by one are kept in a table of bounded size.
    """

    UNITS, AT_ONCE = 300_000, 1 << 20

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.bpe, self.pattern, self.units = BytePairEncoder(ranks), regex.compile(pattern), Recent(self.UNITS)
        self.tokens = pa.array(self.bpe.bytes, pa.large_binary())

    def _pieces(self, units: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Pieces of all units, where each unit's begin, and how many it has. Units that begin with a blank and don't end with one are matched as one string."""
        plain = pc.match_substring_regex(units, f"(?s)^ .*{_SOLID}$")
        joined = units.filter(plain)
        pieces = self.pattern.findall(as_bytes(joined)[0].tobytes().decode())
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        wanted = np.cumsum(pc.utf8_length(joined).to_numpy())
        spot = ends.searchsorted(wanted)
        plain = plain.to_numpy(zero_copy_only=False)
        if len(wanted) and (len(ends) == 0 or ends[-1] != wanted[-1] or (ends[spot] != wanted).any()):  # a pattern that crosses cuts or leaves out characters
            plain, pieces, spot = np.zeros(len(units), bool), [], spot[:0]
        other = self.units.fill(units.filter(pa.array(~plain)).to_pylist(), lambda new: map(self.pattern.findall, new))
        counts, starts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        counts[plain], counts[~plain] = np.diff(spot, prepend=-1), [len(x) for x in other]
        order = np.argsort(~plain, kind="stable")
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return pieces + [x for got in other for x in got], starts, counts

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(texts, _UNSAFE), pc.match_substring(texts, "\0"))
        cuts, whole = pc.split_pattern(pc.replace_substring(texts.filter(pc.invert(odd)), " ", "\0 "), "\0"), texts.filter(odd)
        flat, odd = cuts.flatten(), odd.to_numpy(zero_copy_only=False)
        counts, starts = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
        edges = cuts.offsets.to_numpy()
        counts[~odd], starts[~odd], starts[odd] = np.diff(edges), edges[:-1], len(flat) + np.arange(len(whole))
        units = pa.concat_arrays([flat, whole]).dictionary_encode()
        pieces, first, n = self._pieces(units.dictionary)
        known = pa.array(pieces, pa.large_string()).dictionary_encode()
        of_piece = self.bpe.encode_all(*as_bytes(known.dictionary))
        of_unit = spread_codes(of_piece, known.indices.to_numpy(), first, n)
        return spread_codes(of_unit, units.indices.to_numpy(), starts, counts)

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of some texts (null counts as empty) one after another, and how many each has, until all texts are done."""
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
        ends = np.cumsum(sizes)
        a = 0
        while a < len(texts):
            z = max(a + 1, int(ends.searchsorted(ends[a] - sizes[a] + self.AT_ONCE, "right")))
            if sizes[a] <= self.AT_ONCE:
                ids, counts = self._group(texts.slice(a, z - a))
            else:
                ids = np.concatenate([self._group(pa.array([x], pa.large_string()))[0] for x in self._parts(texts[a].as_py())])
                counts = np.array([len(ids)])
            yield ids, counts
            a = z

    def _parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > self.AT_ONCE and (cut := _CUT.search(text, at + self.AT_ONCE // 2)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str) -> bytes:
        return b"".join(ids.tobytes() for ids, _ in self.encode_all(pa.array([text], pa.large_string())))

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all ids, one after another."""
        data = self.tokens.take(pa.array(ids)).buffers()[2]
        return np.frombuffer(data or b"", np.uint8)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_ENCODERS: dict[tuple, TextEncoder] = {}


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, *, ids: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and the packed ids with ``ids=True``.

    vocabulary is a file of base64 tokens and ranks, read by the driver and broadcast (its size is that of the
    vocabulary, about 1 MB). A null text counts as empty and gives no tokens; rows that repeat are encoded each. The
    ids are decoded again, and decoded_sha256 is over those bytes. Very long texts are encoded whole, part by part, in time linear
    in their length. Other columns are not read; an empty table gives no rows.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (hashlib.sha256(shared.value).digest(), pattern)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = TextEncoder(read_ranks(shared.value), pattern)
        encoder = _ENCODERS[key]
        for b in batches:
            at = 0
            for got, n in encoder.encode_all(b.column(1)):
                back, ends = encoder.decode(got), np.cumsum(n)
                bytes_at = np.append(0, np.cumsum(encoder.bpe.size_of[got]))[np.append(0, ends)]
                spans = list(zip((ends - n).tolist(), ends.tolist(), strict=True))
                sums = [hashlib.sha256(got[a:z]).hexdigest() for a, z in spans]
                backs = [hashlib.sha256(back[a:z]).hexdigest() for a, z in itertools.pairwise(bytes_at.tolist())]
                out = [b.column(0).slice(at, len(n)), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
                if ids:
                    out.append(pa.array([got[a:z].tobytes() for a, z in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
                at += len(n)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)


def encode_corpus(docs: DataFrame, **options) -> DataFrame:
    """encode_texts() with the 50k byte-level vocabulary."""
    return encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, **options)


def query(spark, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))
