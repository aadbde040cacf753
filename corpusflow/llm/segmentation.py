"""N-best SentencePiece segmentation: forward Viterbi, then backward A* over the piece lattice."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import fresh, table

SPACE = "▁"
BATCH_CHARS = 2 << 20
LONG = 64  # longer words are searched one by one
STORED = 400_000  # a worker forgets the words it has searched when it holds more
_U = np.uint64
_TABLE_BITS = 22


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """A model's pieces as a lattice's edges. Scores add up along a path (a BPE model's scores are minus the merge
    ranks). A character that no piece of one character covers is an edge scored 10 below the least piece; it is
    written as its UTF-8 bytes' pieces if the model has them, else as the unknown piece."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        self.ids: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
        self.scores = np.array([sp.get_score(i) for i in range(sp.get_piece_size())], dtype=np.float64)
        self.unknown = sp.unk_id()
        self.unknown_score = float(min((self.scores[i] for i in self.ids.values()), default=0.0)) - 10.0
        self.longest = max(map(len, self.ids), default=1)
        # no piece goes on past the beginning of a word: words can then be searched one by one
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        hashes = np.array([self._hash_of(p) for p in self.ids], dtype=_U)
        order = np.argsort(hashes)
        self.hashes, self.hash_ids = hashes[order], np.array(list(self.ids.values()), dtype=np.int32)[order]
        if len(np.unique(hashes)) != len(hashes):
            raise ValueError("two pieces have one hash")
        slot = (self.hashes >> _U(64 - _TABLE_BITS)).astype(np.int64)
        self.slots = np.full(1 << _TABLE_BITS, -1, dtype=np.int32)  # the first piece of each slot; hashes are sorted
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared = np.append(slot[1:] == slot[:-1], False)  # whether the next piece has the same slot
        self.kept: dict[tuple[str, int], list[tuple[float, list[int], bool]]] = {}
        spelled = {i: piece.replace(SPACE, " ").encode() for piece, i in self.ids.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        table = [spelled.get(i, b"") for i in range(sp.get_piece_size())]
        self.bytes_of = np.array([i in spelled for i in range(len(table))])
        self.opens = np.zeros(len(table), dtype=bool)  # pieces whose first byte is a space before a word
        self.opens[[i for piece, i in self.ids.items() if piece[0] == SPACE]] = True
        self.byte_count = np.array([len(t) for t in table], np.int64)
        self.byte_start = np.cumsum(self.byte_count) - self.byte_count
        self.byte_table = np.frombuffer(b"".join(table), np.uint8)
        self.forget()

    @staticmethod
    def _step(h: np.ndarray, code: np.ndarray) -> np.ndarray:
        h = (h ^ code) * _U(0x9E3779B97F4A7C15)
        return h ^ (h >> _U(29))

    @staticmethod
    def _finish(h: np.ndarray) -> np.ndarray:
        return h * _U(0xBF58476D1CE4E5B9)

    def _pieces_of(self, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1; at: the first piece of its slot."""
        hit = self.hashes[at] == asked
        found = np.where(hit, self.hash_ids[at], -1)
        more = np.flatnonzero(~hit & self.shared[at])
        if len(more):
            near = np.minimum(np.searchsorted(self.hashes, asked[more]), len(self.hashes) - 1)
            found[more] = np.where(self.hashes[near] == asked[more], self.hash_ids[near], -1)
        return found

    def _hash_of(self, piece: str) -> int:
        h = np.zeros(1, _U)
        for c in piece:
            h = self._step(h, np.array([ord(c)], _U))
        return int(self._finish(h)[0])

    def spelled(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "surrogatepass")
        return [self.bytes[b] for b in raw] if all(b in self.bytes for b in raw) else [self.unknown]

    def words(self, text: str) -> list[str]:
        normal = self.sp.normalize(text)
        return re.findall(f"{SPACE}+[^{SPACE}]*|^[^{SPACE}]+", normal) if self.by_word else [normal] if normal else []

    # one word at a time

    def lattice(self, word: str) -> list[list[tuple[int, list[int], float]]]:
        """By end position the edges (start, ids, score)."""
        edges: list[list[tuple[int, list[int], float]]] = [[] for _ in range(len(word) + 1)]
        for start in range(len(word)):
            for end in range(start + 1, min(len(word), start + self.longest) + 1):
                i = self.ids.get(word[start:end])
                if i is not None:
                    edges[end].append((start, [i], float(self.scores[i])))
                elif end == start + 1:
                    edges[end].append((start, self.spelled(word[start]), self.unknown_score))
        return edges

    def n_best(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths (score, ids), best first. Viterbi scores from the left are what A* from the right still
        has to add, exactly, so complete paths come off the heap in order; ties prefer the path nearer its end."""
        edges = self.lattice(word)
        forward = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            forward[end] = max(forward[start] + score for start, _, score in edges[end])
        heap: list[tuple[float, int, int, float, tuple | None]] = [(-forward[-1], len(word), 0, 0.0, None)]
        found, pushed = [], 0
        while heap and len(found) < n:
            _, at, _, done, tail = heapq.heappop(heap)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                found.append((done, ids))
                continue
            for start, ids, score in edges[at]:
                pushed += 1
                heapq.heappush(heap, (-(forward[start] + (done + score)), start, pushed, done + score, (ids, tail)))
        return found

    def _edges(self, word: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The lattice as arrays: start, piece (-1: unknown character) and score of the edges by (end, start), and where
        those of each end position begin."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        n, h = len(codes), np.zeros(len(codes), dtype=_U)
        starts, ends, ids = [], [], []
        for k in range(min(self.longest, n)):
            h = self._step(h[: n - k], codes[k:])
            full = self._finish(h)
            slot = self.slots[(full >> _U(64 - _TABLE_BITS)).astype(np.int64)]
            maybe = np.flatnonzero(slot >= 0)
            piece = self._pieces_of(full[maybe], slot[maybe])
            start, piece = maybe[piece >= 0], piece[piece >= 0]
            if k == 0:
                every = np.full(n, -1, dtype=np.int32)
                every[start] = piece
                start, piece = np.arange(n), every
            starts.append(start)
            ends.append(start + k + 1)
            ids.append(piece)
        start, end, piece = (np.concatenate(x) for x in (starts, ends, ids))
        order = np.lexsort((start, end))
        piece = piece[order]
        score = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.unknown_score)
        return start[order], piece, score, np.searchsorted(end[order], np.arange(n + 2))

    def n_best_long(self, word: str, n: int) -> list[tuple[float, list[int]]]:
        """n_best() for words of any length: the lattice is arrays, the forward pass keeps the n best scores of the last
        positions, and A* leaves out what can't come up to the n-th best path, so that it visits about n nodes for each
        position (more only at ties)."""
        start, piece, score, begin = self._edges(word)
        size, span = len(word), min(self.longest, len(word))
        forward, best = np.zeros(size + 1), [[0.0]] + [[]] * span  # best: a ring of the last positions
        for low in range(1, size + 1, 1 << 14):  # edges become Python numbers a block at a time
            high = min(size + 1, low + (1 << 14))
            first = int(begin[low])
            s, c, b = start[first : begin[high]].tolist(), score[first : begin[high]].tolist(), (begin[low : high + 1] - first).tolist()
            tops = []
            for end in range(low, high):
                found = [x + c[e] for e in range(b[end - low], b[end - low + 1]) for x in best[s[e] % (span + 1)]]
                found.sort(reverse=True)
                best[end % (span + 1)] = found[:n]
                tops.append(found[0])
            forward[low:high] = tops
        least = best[size % (span + 1)][-1]
        least -= 1e-9 * (1 + abs(least))
        heap, done, parent, via = [(-float(forward[size]), size, 0)], [0.0], [-1], [-1]
        found = []
        while heap and len(found) < n:
            _, at, own = heapq.heappop(heap)
            if at == 0:
                total, ids = done[own], []
                while own:
                    ids.append(via[own])
                    own = parent[own]
                tokens = piece[np.array(ids, np.int64)]
                found.append((total, [i for e, t in zip(ids, tokens.tolist()) for i in ([t] if t >= 0 else self.spelled(word[start[e]]))]))
                continue
            for e in range(begin[at], begin[at + 1]):
                so_far = done[own] + float(score[e])
                value = float(forward[start[e]]) + so_far
                if value >= least:
                    heapq.heappush(heap, (-value, int(start[e]), len(done)))
                    done.append(so_far)
                    parent.append(own)
                    via.append(e)
        return found

    def n_best_kept(self, word: str, n: int) -> list[tuple[float, list[int], bool]]:
        """The n best paths, each with whether it spells the word."""
        if len(word) > LONG:
            return self._checked(word, self.n_best_long(word, n))
        if (word, n) not in self.kept:
            if len(self.kept) > 20_000:
                self.kept.clear()
            self.kept[word, n] = self._checked(word, self.n_best(word, n))
        return self.kept[word, n]

    def _checked(self, word: str, paths: list[tuple[float, list[int]]]) -> list[tuple[float, list[int], bool]]:
        ids = np.array([i for _, path in paths for i in path], np.int64)
        spelled = self.text_of(ids, np.cumsum([len(path) for _, path in paths]))
        return [(score, path, raw == _written(word)) for (score, path), raw in zip(paths, spelled)]

    def text_of(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
        """The bytes that each stretch of ids stands for, without the space before the first word; None if it holds
        pieces that stand for none of their own."""
        written = self.bytes_of[ids]
        upto = np.concatenate(([0], np.cumsum(self.byte_count[ids])))
        whole = self.byte_table[np.repeat(self.byte_start[ids] - upto[:-1], self.byte_count[ids]) + np.arange(upto[-1])].tobytes()
        bad = np.concatenate(([0], np.cumsum(~written)))
        low = np.concatenate(([0], ends[:-1]))
        return [None if bad[b] > bad[a] else whole[upto[a] + (b > a and self.opens[ids[a]]) : upto[b]] for a, b in zip(low.tolist(), ends.tolist())]

    # many words at a time

    def _best_of(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words of at most `width` characters: best score, gap to the second-best path (inf if there is none),
        tokens in one array, and how many each word has. Negative tokens are -1 - code point, to be spelled."""
        n, span = len(words), min(self.longest, width)
        length = np.fromiter(map(len, words), np.int64, n)
        codes = np.zeros((n, width), dtype=np.uint32)
        codes[np.arange(width)[None] < length[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.ascontiguousarray(codes.T)  # by position, then word: every step below works on whole rows
        wide = codes.astype(_U)
        ids: list[np.ndarray] = []  # ids[k][start, word]: the piece of k + 1 characters there, or -1
        h = np.zeros((width, n), dtype=_U)
        for k in range(span):
            h = self._step(h[: width - k], wide[k:])
            full = self._finish(h)
            own = np.full(full.shape, -1, dtype=np.int32)
            slot = self.slots[(full >> _U(64 - _TABLE_BITS)).astype(np.int64)]
            maybe = np.flatnonzero((slot >= 0) & (np.arange(k, width)[:, None] < length[None]))
            own.reshape(-1)[maybe] = self._pieces_of(full.reshape(-1)[maybe], slot.reshape(-1)[maybe])
            ids.append(own)
        some = [(x >= 0).any(axis=1) for x in ids]
        first = np.where(ids[0] >= 0, self.scores[np.maximum(ids[0], 0)], self.unknown_score)
        best = np.full((width + 1, n), -np.inf)  # of the paths to a position, and of all but the best
        second = np.full((width + 1, n), -np.inf)
        back = np.zeros((width + 1, n), dtype=np.int8)
        best[0] = 0
        for end in range(1, width + 1):
            for k in range(min(span, end)):
                start = end - 1 - k
                if k and not some[k][start]:
                    continue
                own = first[start] if k == 0 else np.where(ids[k][start] >= 0, self.scores[np.maximum(ids[k][start], 0)], -np.inf)
                one, two = best[start] + own, second[start] + own
                back[end][one > best[end]] = k + 1
                second[end] = np.maximum(np.maximum(two, second[end]), np.minimum(one, best[end]))
                best[end] = np.maximum(one, best[end])
        row, at, turns = np.arange(n), length.copy(), []
        none = np.iinfo(np.int64).min
        tops, seconds = best[length, row], second[length, row]
        while len(row):
            step = back[at, row].astype(np.int64)
            at = at - step
            token = np.full(len(row), -1, dtype=np.int64)
            for k in np.unique(step):
                own = step == k
                token[own] = ids[k - 1][at[own], row[own]]
            token = np.where(token >= 0, token, -1 - codes[at, row].astype(np.int64))
            full = np.full(n, none)
            full[row] = token
            turns.append(full)
            row, at = row[at > 0], at[at > 0]
        grid = np.stack(turns[::-1], axis=1) if turns else np.zeros((n, 0), np.int64)
        there = grid != none
        return tops, tops - seconds, grid[there], there.sum(axis=1)

    def learn(self, words: list[str]) -> None:
        """Adds distinct new words of any length to the store, in their order: `number` has numbered them so."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        found, low = [], 0
        for high in (4, 8, 12, 16, 24, 40, LONG):
            picked = np.flatnonzero((length > low) & (length <= high))
            rows = (1 << 16) // high
            for at in range(0, len(picked), rows):
                own = picked[at : at + rows]
                found.append((own, *self._best_of([words[i] for i in own], high)))
            low = high
        for i in np.flatnonzero(length > LONG):
            two = self.n_best_long(words[i], 2)
            gap = two[0][0] - two[1][0] if len(two) > 1 else np.inf
            ids = np.array(two[0][1], np.int64)
            found.append((np.array([i]), np.array([two[0][0]]), np.array([gap]), ids, np.array([len(ids)])))
        if not found:
            return
        order, best, gap, tokens, count = (np.concatenate(x) for x in zip(*found))
        tokens, count = self.spell(tokens, count)
        ends = np.cumsum(count)
        exact = np.concatenate([self._spells([words[i] for i in order[at : at + 4096]], tokens[int(ends[at] - count[at]) : int(ends[min(at + 4096, len(ends)) - 1])], count[at : at + 4096]) for at in range(0, len(order), 4096)])
        by = np.argsort(order)
        self.exact, self.best, self.gap, self.count = (np.append(x, new[by]) for x, new in ((self.exact, exact), (self.best, best), (self.gap, gap), (self.count, count)))
        self.offset = np.append(self.offset, (len(self.tokens) + ends - count)[by])
        self.tokens = np.append(self.tokens, tokens)

    def _spells(self, words: list[str], tokens: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether each word's tokens, count of them, spell it. Bytes are compared for all words at once, and if all
        words have as many as their tokens, that says it of each; else word by word."""
        ends = np.cumsum(count)
        joined = "".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.where(codes == ord(SPACE), 1, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64))
        wanted = np.diff(np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))))])
        upto = np.concatenate(([0], np.cumsum(self.byte_count[tokens])))
        if self.bytes_of[tokens].all() and (np.diff(upto[np.concatenate(([0], ends))]) == wanted).all():
            whole = self.byte_table[np.repeat(self.byte_start[tokens] - upto[:-1], self.byte_count[tokens]) + np.arange(upto[-1])]
            if whole.tobytes() == joined.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                return np.ones(len(words), dtype=bool)
        return np.array([raw == _written(word) for word, raw in zip(words, self.text_of(tokens, ends))], dtype=bool)

    def forget(self) -> None:
        self.number = _Numbers()
        self.best, self.gap, self.exact = np.zeros(0), np.zeros(0), np.zeros(0, bool)
        self.count, self.offset, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def spell(self, tokens: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Negative tokens replaced by the pieces of the character's bytes."""
        bad = np.flatnonzero(tokens < 0)
        if not len(bad):
            return tokens.astype(np.int32), count
        kinds, which = np.unique(tokens[bad], return_inverse=True)
        written = [self.spelled(chr(-1 - int(t))) for t in kinds]
        size = np.ones(len(tokens), np.int64)
        size[bad] = np.array([len(w) for w in written])[which]
        out = np.repeat(tokens, size).astype(np.int32)
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        for k, w in enumerate(written):
            for j, piece in enumerate(w):
                out[starts[bad[which == k]] + j] = piece
        upto = np.concatenate(([0], np.cumsum(size)))
        ends = np.cumsum(count)
        return out, upto[ends] - upto[ends - count]


class _Numbers(dict):
    """Numbers words in the order they come; new: those since it was emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


def _written(word: str) -> bytes:
    """What a word's pieces stand for, without the space before it."""
    return word[word.startswith(SPACE) :].replace(SPACE, " ").encode("utf-8", "surrogatepass")


@cache
def _pieces(path: str) -> Pieces:
    """One model per Python worker."""
    return Pieces(path)


def segment(pieces: Pieces, texts: list[str], n: int) -> Iterator[tuple[int, int, float, np.ndarray, bool]]:
    """(text's index, rank from 1, score, ids, exact) of the n best segmentations of each text. exact: the words' pieces
    spell them, and they the text; a distinct word is spelled once and not wherever it occurs.

    Words are independent parts of the lattice. A path that departs from the best one in a word loses at least the
    word's gap to its second-best path, so the n best depart only in the n - 1 words of the smallest gaps (ties: the
    earlier word). Only there does A* run; its lists are merged by their losses, exactly.
    """
    if len(pieces.number) > STORED:
        pieces.forget()
    split = [pieces.words(t) for t in texts]
    numbered = np.fromiter(map(pieces.number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
    new, pieces.number.new = pieces.number.new, []
    try:
        pieces.learn(new)
    except BaseException:
        pieces.forget()  # numbers without words behind them
        raise
    best, gap, tokens, count, offset = pieces.best, pieces.gap, pieces.tokens, pieces.count, pieces.offset
    low = 0
    for i, words in enumerate(split):
        which = numbered[low : low + len(words)]
        low += len(words)
        size = count[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(offset[which] - (ends - size), size)
        ids, score = tokens[index], float(best[which].sum())
        plain = "".join(words).replace(SPACE, " ")
        same = plain[plain.startswith(" ") :] == texts[i]
        exact = pieces.exact[which]
        wrong = int((~exact).sum())
        yield i, 1, score, ids, same and not wrong
        if n < 2 or not len(which):
            continue
        gaps = gap[which]
        near = np.flatnonzero(np.isfinite(gaps))
        if len(near) > n - 1:
            cut = np.partition(gaps[near], n - 2)[n - 2]
            below, equal = near[gaps[near] < cut], near[gaps[near] == cut]
            near = np.sort(np.concatenate((below, equal[: n - 1 - len(below)])))
        merged: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
        lists = {}
        for w in near:
            lists[w] = pieces.n_best_kept(words[w], n)
            top = lists[w][0][0]
            merged = sorted((loss + (top - s), (*path, (int(w), j)) if j else path) for loss, path in merged for j, (s, _, _) in enumerate(lists[w]))[:n]
        for rank, (loss, path) in enumerate(merged[1:], 2):
            parts, at = [], 0
            for w, j in path:
                parts += [ids[at : ends[w] - size[w]], np.array(lists[w][j][1], np.int32)]
                at = ends[w]
            left = wrong - sum(not exact[w] for w, _ in path)
            yield i, rank, score - loss, np.concatenate([*parts, ids[at:]]), same and not left and all(lists[w][j][2] for w, j in path)


def n_best_segmentations(documents: DataFrame, model: str, n: int = 3) -> DataFrame:
    """(doc_id, rank, score, ids, exact): the n best segmentations of every whole text into the model's pieces, best
    first; exact says whether they decode to the text itself (what the model normalises away, they can't).

    score is the sum of the piece scores. Texts with fewer segmentations give fewer rows; the empty text gives one of
    score 0 without ids; null texts give none. Equal scores are ordered the same way every time. A null doc_id is
    carried, and doc_id keeps its type; repeated rows are each segmented; other columns are not read; an empty table
    gives no rows. Words of any length are searched whole, in time linear in them. model is a path all executors can
    read. Nothing is shuffled. decode() gives the text back from any of the segmentations.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for batch in batches:
            size = np.cumsum(batch.column(2).to_numpy())
            at = 0
            while at < batch.num_rows:  # about BATCH_CHARS characters, one text at least
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_CHARS, side="right")))
                part = batch.slice(at, to - at)
                texts = part.column(1).to_pylist()
                found = list(segment(pieces, texts, n))
                ends = np.cumsum([len(f[3]) for f in found])
                ids = np.concatenate([f[3] for f in found]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([f[0] for f in found])), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.float64()), lists, pa.array([f[4] for f in found], pa.bool_())], names=["doc_id", "rank", "score", "ids", "exact"])
                at = to

    rows = documents.where("text is not null").select("doc_id", "text", F.length("text").cast("bigint").alias("size"))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL("rank int, score double, ids array<int>, exact boolean").fields]))


def decode(segmented: DataFrame, model: str, name: str = "text") -> DataFrame:
    """segmented with the text that its ids stand for, in a column `name` (with underscores where taken); null where ids
    is null, empty where it has none. Bytes that are no UTF-8 and pieces without a text are written as the model's own
    decoder does. Repeated rows, ties and other columns, whatever their names, stay as they are; an empty table stays
    empty. Nothing is shuffled."""
    name = fresh(segmented.columns, name)
    schema = T.StructType([*segmented.schema.fields, T.StructField(name, T.StringType())])
    at = segmented.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(model)
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                lists = batch.column(at)
                ids, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
                texts: list[str | None] = []
                for k, raw in enumerate(pieces.text_of(ids, ends)):
                    try:
                        texts.append(raw.decode() if raw is not None else pieces.sp.decode(lists[k].as_py()))
                    except UnicodeDecodeError:
                        texts.append(pieces.sp.decode(lists[k].as_py()))
                mask = lists.is_null().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string(), mask=mask)], names=[*batch.schema.names, name])

    return segmented.mapInArrow(run, schema)


def op6_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best segmentations of every text, each decoded and compared with it."""
    return n_best_segmentations(table(spark, sf_dir, "documents"), default_model())


QUERIES = {"op6_sentencepiece_nbest": op6_sentencepiece_nbest}
SQL: dict[str, str] = {}
