"""Alignment of two tokenizers over the same bytes: groups of tokens that end together, and links of tokens that overlap.

A transducer goes over both id sequences at once. Its state is the side that leads and the bytes by which it leads (the
dangling suffix of its last token); the next token always comes from the side behind, links with the leader's last token,
and either shortens the suffix or leads with a suffix of its own. A group closes where the suffix is empty. Moves are
remembered by state and token. Bytes that do not match end the walk: such a text has no tokens.

Both tokenizers break before a space or newline that follows anything but white space (checked on their files; where one
does not, a text is one unit), so the walk is done once for each distinct unit, a word with the white space before it, as
far as a worker remembers. Both sides end together at every such break.

A link's count is the number of documents of the whole corpus that hold its pair of ids. Documents are worked on in
blocks bounded by characters; a block lists its distinct pairs with the number of its documents that hold them, pairs are
summed over blocks in Spark, and sums come back to the blocks that asked. So what moves is a row for a pair and block,
nothing is broadcast, and a common pair is one row a block before it moves.

Defined results: null or empty text, and text that either tokenizer does not give back byte by byte, has no tokens, links
or groups. Rows that repeat are documents of their own; a null doc_id is kept. Texts of any length go through in slices
that end at breaks; a word of any length is one unit. Columns other than doc_id and text are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.frames import Bucketed, map_rows, map_stream, packed, unpacked

NO_ONE, LEFT, RIGHT = range(3)
MARK = "▁"
SLICE, BLOCK = 1 << 20, 8 << 20
#: Tokens of both sides up to which units are walked together.
TOGETHER = 40
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_GAP_AT_END = re.compile(r"\s[ \n]|\x01")
#: Marks that a byte-level tokenizer breaks off after a letter; the apostrophe begins endings of its own.
_MARKS = ".,;:!?*#$%&()[]{}<>/+=-\""
_GAP = re.compile(r"[\s\x1c-\x1f]")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteSide:
    """A byte-level tokenizer of the tokenizers library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        letters, added = byte_letters(), self.tokenizer.get_added_tokens_decoder()
        self.raw = {i: x.encode() if i in added else bytes(letters[c] for c in x) for x, i in self.tokenizer.get_vocab().items()}
        self.names = {i: str(i) for i in self.raw}
        kind = json.loads(self.tokenizer.to_str())
        before = kind["pre_tokenizer"] or {}
        self.breaks = kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")

    def encode(self, unit: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([unit], add_special_tokens=False)[0].ids

    def encode_words(self, words: list[str]) -> list[list[int]] | None:
        """Ids of words with a space before each: one text, a newline after each word."""
        (newline,) = self.encode("\n")
        return _cut_after(self.encode("\n".join(words) + "\n"), newline, len(words))


    def encode_lines(self, lines: list[str]) -> list[list[int]] | None:
        """Ids of words with a newline before each: one text, cut before each newline."""
        (newline,) = self.encode("\n")
        return _cut_before(self.encode("".join(lines)), {newline}, len(lines))


def _cut_before(ids: list[int], starts: set[int], parts: int) -> list[list[int]] | None:
    at = [k for k, x in enumerate(ids) if x in starts]
    return [ids[a:b] for a, b in zip(at, [*at[1:], len(ids)], strict=True)] if len(at) == parts and at[0] == 0 else None


def _cut_after(ids: list[int], end: int, parts: int) -> list[list[int]] | None:
    at = [k for k, x in enumerate(ids) if x == end]
    return [ids[a + 1 : b] for a, b in zip([-1, *at], at, strict=False)] if len(at) == parts else None


class PieceSide:
    """A SentencePiece model that puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw, self.breaks = {}, True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.raw[i] = bytes([int(_BYTE.fullmatch(piece)[1], 16)])
            else:
                self.raw[i] = piece.replace(MARK, " ").encode()
                self.breaks &= MARK not in piece.lstrip(MARK) and ("\n" not in piece or piece == "\n")
        self.names = {i: str(i) for i in self.raw}
        met = {b for i in self.raw for a, b in pairwise(self.model.id_to_piece(i)) if a.isalpha()}
        self.marks = "".join(m for m in _MARKS if m not in met)
        self.led = {i for i, x in self.raw.items() if x.startswith(b" ")}
        self.lines = {i for i, x in self.raw.items() if x == b"\n"}

    def encode(self, unit: str) -> list[int]:
        """Ids of a unit: one that begins with a space takes the model's own, another loses it (by a newline, where it has none).

        The model puts none before an empty text, so that a space alone is looked up.
        """
        if unit == " ":
            return [self.model.piece_to_id(MARK)]
        if unit[0] == " ":
            return self.model.encode(unit[1:])
        ids = self.model.encode(unit if unit[0] == "\n" else "\n" + unit)
        if unit[0] == "\n":
            return ids[1:] if ids and self.raw[ids[0]] == b" " else []
        return ids[next((k for k, x in enumerate(ids) if self.raw[x] == b"\n"), len(ids)) + 1 :]

    def encode_words(self, words: list[str]) -> list[list[int]] | None:
        """Ids of words with a space before each: one text, cut where a piece begins with a space."""
        return _cut_before(self.model.encode("".join(words)[1:]), self.led, len(words))

    def encode_lines(self, lines: list[str]) -> list[list[int]] | None:
        """Ids of words with a newline before each: one text without the model's own space, cut before each newline."""
        return _cut_before(self.model.encode("".join(lines))[1:], self.lines, len(lines))


class Aligner:
    """Walks units, and remembers moves and units until they hold `most` bytes or so."""

    def __init__(self, left: ByteSide | PieceSide, right: ByteSide | PieceSide, most: int = 40 << 20):
        self.left, self.right, self.most = left, right, most
        self.breaks = left.breaks and right.breaks
        marks = re.escape(getattr(right, "marks", ""))
        self.tail = re.compile(rf"( [^\W\d_]+)([{marks}]+)") if marks and self.breaks else None
        self.units: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.held = 0
        self._forget()

    def known(self, unit: str) -> tuple | None | bool:
        """What is remembered of a unit, False if nothing is; what was used stays when older units are forgotten."""
        if unit in self.units:
            return self.units[unit]
        if unit in self.before:
            x = self.units[unit] = self.before[unit]
            return x
        return False

    def _forget(self) -> None:
        """Only the state in which nothing dangles is known; moves lie as sorted keys (state and token) with the state after."""
        self.states: list[tuple[int, bytes]] = [(NO_ONE, b"")]
        self.number = {self.states[0]: 0}
        self.leads, self.leading = [NO_ONE], np.array([NO_ONE])
        self.keys, self.to = np.array([-1]), np.array([0])

    def move(self, state: int, token: int) -> int:
        """The state after the next token of the side behind (the left one where none leads); -1 where bytes differ."""
        side, rest = self.states[state]
        raw = (self.right if side == LEFT else self.left).raw[token]
        if len(raw) < len(rest):
            new = (side, rest[len(raw) :]) if rest.startswith(raw) else None
        elif not raw.startswith(rest):
            new = None
        elif len(raw) == len(rest):
            new = NO_ONE, b""
        else:
            new = RIGHT if side == LEFT else LEFT, raw[len(rest) :]
        if new is None:
            out = -1
        else:
            if new not in self.number:
                self.number[new] = len(self.states)
                self.states.append(new)
                self.leads.append(new[0])
            out = self.number[new]
        return out

    def _next(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The state after each move; moves not met before are worked out once and remembered."""
        keys = states << 20 | tokens
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = np.unique(keys[self.keys[at] != keys])
        if len(new):
            found = [self.move(k >> 20, k & (1 << 20) - 1) for k in new.tolist()]
            self.leading = np.array(self.leads)
            keys_now, to_now = np.concatenate([self.keys, new]), np.concatenate([self.to, found])
            order = np.argsort(keys_now)
            self.keys, self.to = keys_now[order], to_now[order]
            at = np.searchsorted(self.keys, keys)
        return self.to[at]

    def walk_one(self, left: list[int], right: list[int]) -> tuple[list[tuple[int, int]], np.ndarray] | None:
        """`walk` for one unit."""
        moves: dict[tuple[int, int], int] = {}
        state, i, j, groups, links = 0, 0, 0, [], []
        while i < len(left) or j < len(right):
            right_turn = self.leads[state] == LEFT
            if (j == len(right)) if right_turn else (i == len(left)):
                return None
            token = right[j] if right_turn else left[i]
            i, j = i + (not right_turn), j + right_turn
            if state:
                links.append(left[i - 1] << 32 | right[j - 1])
            if (state, token) not in moves:
                moves[state, token] = self.move(state, token)
            state = moves[state, token]
            if state < 0:
                return None
            if not state:
                groups.append((i, j))
        self.leading = np.array(self.leads)
        return None if state else (groups, np.array(links, np.int64))

    def walk(self, left: list[list[int]], right: list[list[int]]) -> list[tuple[list[tuple[int, int]], np.ndarray] | None]:
        """For each unit the ends of its groups on either side and its links in order as packed ids; None where bytes differ.

        The transducers of all units go on together, a token each at a time; those of long units alone.
        """
        long = [len(x) + len(y) > TOGETHER for x, y in zip(left, right, strict=True)]
        if any(long):
            short = iter(self.walk([x for x, z in zip(left, long, strict=True) if not z], [y for y, z in zip(right, long, strict=True) if not z]))
            return [self.walk_one(x, y) if z else next(short) for x, y, z in zip(left, right, long, strict=True)]
        a, b = (np.fromiter(chain.from_iterable(x), np.int64) for x in (left, right))
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
        (first_i, end_i), (first_j, end_j) = ((np.cumsum(n) - n, np.cumsum(n)) for n in sizes)
        a, b = np.append(a, 0), np.append(b, 0)
        i, j, state = first_i.copy(), first_j.copy(), np.zeros(len(left), np.int64)
        failed, live = np.zeros(len(left), bool), np.arange(len(left))
        links, closed = [], []
        while True:
            own = state[live]
            right_turn = self.leading[own] == LEFT
            over = np.where(right_turn, j[live] == end_j[live], i[live] == end_i[live])
            failed[live[over & ((own > 0) | (j[live] < end_j[live]))]] = True
            live, own, right_turn = live[~over], own[~over], right_turn[~over]
            if not len(live):
                break
            token = np.where(right_turn, b[j[live]], a[i[live]])
            j[live] += right_turn
            i[live] += ~right_turn
            met = live[own > 0]
            links.append((met, a[i[met] - 1] << 32 | b[j[met] - 1]))
            state[live] = now = self._next(own, token)
            failed[live[now < 0]] = True
            ended = live[now == 0]
            closed.append((ended, i[ended] - first_i[ended], j[ended] - first_j[ended]))
            live = live[now >= 0]
        groups: list[list[tuple[int, int]]] = [[] for _ in left]
        for units, ends_i, ends_j in closed:
            for u, x, y in zip(units.tolist(), ends_i.tolist(), ends_j.tolist(), strict=True):
                groups[u].append((x, y))
        owner, packed_ids = (np.concatenate(x) for x in zip(*links, strict=True)) if links else (np.zeros(0, np.int64),) * 2
        order = np.argsort(owner, kind="stable")
        each = np.split(packed_ids[order], np.cumsum(np.bincount(owner, minlength=len(left)))[:-1]) if len(left) else []
        return [None if bad else (g, x) for bad, g, x in zip(failed.tolist(), groups, each, strict=True)]

    def _encoded(self, units: list[str]) -> Iterator[tuple[list[str], list[list[int]], list[list[int]]]]:
        """Words, of which most units are, go to the tokenizers many at once."""
        kinds: dict[str, list[str]] = {" ": [], "\n": []}
        rest = []
        for u in units:
            (kinds[u[0]] if self.breaks and u[0] in kinds and len(u) > 1 and MARK not in u and not _GAP.search(u, 1) else rest).append(u)
        for first, words in kinds.items():
            for at in range(0, len(words), 4096):
                some = words[at : at + 4096]
                a, b = (side.encode_words(some) if first == " " else side.encode_lines(some) for side in (self.left, self.right))
                if a is None or b is None:
                    rest += some
                else:
                    yield some, a, b
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            yield some, [self.left.encode(u) for u in some], [self.right.encode(u) for u in some]

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """Units to (groups, left tokens, right tokens, number of groups, links as packed ids).

        Where both tokenizers break between a word and the marks after it, a unit is put together from the two.
        """
        cut = {u: m.groups() for u in units if (m := self.tail.fullmatch(u)) and m[1][-1].isalpha()} if self.tail else {}
        parts = {p: self.known(p) for both in cut.values() for p in both}
        parts |= self._learn([*(u for u in units if u not in cut and u not in parts), *(p for p, x in parts.items() if x is False)])
        out = {u: parts[u] for u in units if u not in cut}
        for u, (word, marks) in cut.items():
            x, y = parts[word], parts[marks]
            out[u] = x and y and (f"{x[0]};{y[0]}", x[1] + y[1], x[2] + y[2], x[3] + y[3], x[4] + y[4])
        if self.held > self.most:
            self.units, self.before, self.held = {}, self.units, 0
        short = {u: x for u, x in (parts | out).items() if len(u) <= 64}
        self.units.update(short)
        self.held += sum(400 + len(u) + (len(x[0]) + len(x[4]) if x else 0) for u, x in short.items())
        return out

    def _learn(self, units: list[str]) -> dict[str, tuple | None]:
        out: dict[str, tuple | None] = {}
        if len(self.keys) > 1 << 19:
            self._forget()
        raw, names_a, names_b = self.left.raw, self.left.names, self.right.names
        for some, left, right in self._encoded(units):
            for unit, a, b, done in zip(some, left, right, self.walk(left, right), strict=True):
                if done is None or b"".join([raw[x] for x in a]) != unit.encode():
                    out[unit] = None
                    continue
                text, x, y = [], 0, 0
                for p, q in done[0]:
                    text.append(f"{','.join([names_a[k] for k in a[x:p]])}|{','.join([names_b[k] for k in b[y:q]])}")
                    x, y = p, q
                out[unit] = ";".join(text), len(a), len(b), len(text), done[1].tobytes()
        return out

    def slices(self, text: str) -> Iterator[list[str]]:
        """The units of a text, of at most a slice and a unit at a time."""
        if not self.breaks:
            yield [text]
            return
        at = 0
        while len(text) - at > SLICE and (cut := _CUT.search(text, at + SLICE)):
            yield _split(text[at : cut.start()])
            at = cut.start()
        yield _split(text[at:] if at else text)


def _split(text: str) -> list[str]:
    if _GAP_AT_END.search(text):
        return _CUT.split(text)
    return [u for u in text.replace("\n", "\x01\n").replace(" ", "\x01 ").split("\x01") if u]


@lru_cache(maxsize=1)
def aligner_of(left: str, right: str) -> Aligner:
    """One aligner a Python worker: what a task has met helps the next."""
    return Aligner(ByteSide(left), PieceSide(right))


class _Block:
    """Documents, distinct units and distinct pairs of a block, by their numbers in it."""

    def __init__(self, as_text: bool):
        self.at: dict[str, int] = {}
        self.known: list[tuple | None] = []
        self.docs: list[tuple[int | None, np.ndarray, str]] = []
        self.unsound: set[int] = set()
        self.as_text, self.chars = as_text, 0

    def add(self, aligner: Aligner, rows: list[tuple[int | None, str]]) -> None:
        """Documents; units that are new in the block are learnt for many documents at once."""
        seqs: list[list[np.ndarray]] = [[] for _ in rows]
        waiting: list[tuple[int, list[str]]] = []

        def settle() -> None:
            missing = {u: aligner.known(u) for u in dict.fromkeys(u for _, units in waiting for u in units if u not in self.at)}
            fresh = [u for u, x in missing.items() if x is False]
            missing |= aligner.learn(fresh) if fresh else {}
            for u, x in missing.items():
                if x is None:
                    self.unsound.add(len(self.known))
                self.at[u] = len(self.known)
                self.known.append(x)
            self.chars += sum(map(len, missing))
            for k, units in waiting:
                seqs[k].append(np.fromiter(map(self.at.__getitem__, units), np.int32, len(units)))
            waiting.clear()

        held = 0
        for k, (_, text) in enumerate(rows):
            for units in aligner.slices(" " + text) if text else ():
                waiting.append((k, units))
                held += len(units)
                if held >= 1 << 17:
                    settle()
                    held = 0
        settle()
        for (doc_id, text), parts in zip(rows, seqs, strict=True):
            whole = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            if self.unsound and not self.unsound.isdisjoint(whole.tolist()):
                whole = whole[:0]
            self.docs.append((doc_id, whole, self._groups(whole)))
            self.chars += len(text)

    def _groups(self, seq: np.ndarray) -> str:
        """The groups of a document, or the digest of that text, which is put together in pieces."""
        parts = (";".join([self.known[k][0] for k in seq[at : at + 65536].tolist()]) for at in range(0, len(seq), 65536))
        if self.as_text:
            return ";".join(parts)
        chain_ = hashlib.sha256()
        for k, part in enumerate(parts):
            chain_.update((";" + part if k else part).encode())
        return chain_.hexdigest() if len(seq) else ""

    def row(self, number: int) -> tuple:
        none = ("", 0, 0, 0, b"")
        known = [x or none for x in self.known]
        size = np.array([len(x[4]) // 8 for x in known], np.int32)
        pairs, index = np.unique(np.frombuffer(b"".join([x[4] for x in known]), np.int64), return_inverse=True)
        ends, index = np.cumsum(size), index.astype(np.int32)
        met = np.zeros(len(pairs), np.int64)
        for _, seq, _ in self.docs:
            used = np.unique(seq)
            n = size[used]
            before = np.cumsum(n) - n
            met[np.unique(index[np.repeat(ends[used] - n - before, n) + np.arange(n.sum())])] += 1
        stats = np.array([[x[1], x[2], x[3]] for x in known], np.int64).reshape(-1, 3)
        return (
            number, [d for d, _, _ in self.docs], [packed(s) for _, s, _ in self.docs], [g for _, _, g in self.docs],
            [stats[s].sum(axis=0).tolist() for _, s, _ in self.docs], size.astype(np.int32).tobytes(), packed(index), pairs.tolist(), met.tolist(),
        )


BLOCKS = "block long, doc_ids array<long>, seqs array<binary>, groups array<string>, stats array<array<long>>, sizes binary, indexes binary, pairs array<long>, met array<long>"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"


def align(docs: DataFrame, left: str, right: str, as_text: bool = False, block_chars: int = BLOCK) -> DataFrame:
    """docs(doc_id, text, ...) under the byte-level tokenizer `left` and the SentencePiece model `right`, over space + text.

    n_links counts pairs of tokens that overlap, n_best those whose count is the highest of their left id, count_sum is
    the sum of their counts. groups_sha256 is the digest of the groups, written `a1,a2|b1;a3|b2,b3` ('' without tokens);
    with `as_text` they come whole, as groups. The result does not depend on `block_chars`.
    """

    def blocks(rows: Iterator[tuple]) -> Iterator[tuple]:
        aligner, number, block = aligner_of(left, right), TaskContext.get().partitionId() << 32, _Block(as_text)
        waiting, held = [], 0
        for row in rows:
            waiting.append(row)
            held += len(row[1])
            if held >= min(SLICE, block_chars):
                block.add(aligner, waiting)
                waiting, held = [], 0
                if block.chars >= block_chars:
                    yield block.row(number)
                    number, block = number + 1, _Block(as_text)
        block.add(aligner, waiting)
        if block.docs:
            yield block.row(number)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    kept = Bucketed(map_stream(given, BLOCKS, lambda: blocks, flush_rows=1), "block").df
    asked = kept.select("block", F.posexplode(F.arrays_zip("pairs", "met")).alias("pos", "x")).select("block", "pos", F.col("x.pairs").alias("pair"), F.col("x.met").alias("met"))
    counts = asked.groupBy("pair").agg(F.sum("met").alias("count"))
    # an id of one side has as many partners as the other's vocabulary at most
    best = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    scored = counts.select("pair", "count", (F.col("count") == best).alias("best"))
    back = asked.select("block", "pos", "pair").join(scored, "pair").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "count", "best"))).alias("found"))
    met = kept.drop("pairs", "met").join(back.select("block", F.col("found.count").alias("counts"), F.col("found.best").alias("best")), "block", "left")

    def told() -> Callable[[tuple], Iterable[tuple]]:
        def f(row: tuple) -> Iterator[tuple]:
            _, doc_ids, seqs, groups, stats, sizes, indexes, counts, best = row
            size, index = np.frombuffer(sizes, np.int32), unpacked(indexes)
            ends = np.cumsum(size)
            known = [size, *(_sums(np.array(x or [], np.int64), index, ends, size) for x in (best, counts))]
            for doc_id, seq, own, text in zip(doc_ids, seqs, stats, groups, strict=True):
                units = unpacked(seq)
                yield doc_id, *own, *(int(x[units].sum()) for x in known), text

        return f

    return map_rows(met, f"{ALIGNED}, {'groups' if as_text else 'groups_sha256'} string", told, flush_rows=512, weigh=7)


def _sums(values: np.ndarray, index: np.ndarray, ends: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each unit the sum of the values of its links."""
    total = np.concatenate([[0], np.cumsum(values[index])]) if len(index) else np.zeros(1, np.int64)
    return total[ends] - total[ends - size]
