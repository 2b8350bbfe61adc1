"""Byte-level BPE by a tokenization automaton: tables instead of merges at run time.

The automaton reads tokens. It starts as one state with an arc for each byte, and each merge
(a, b) -> c in turn adds its gadget: from every state with an arc a, an arc c goes to where b led
from there, and a leads to a copy of its state that lacks the arc b. What the automaton then
accepts, word by word, is the one sequence of tokens that the merges in their order would have
left (Berglund, Martens, van der Merwe, "Constructing a BPE Tokenization DFA", 2024). All arcs of
one token lead to one state: this holds for bytes, and a gadget sends all arcs a to the same copy and
all arcs c to the state of b. So the automaton is a state for each token, and for each state the
set of arcs that it lacks: a table of bits, tokens by states (92 MB for 50,000 merges, and
never more than the square of the vocabulary, whatever the data).

Encoding. Words come from the tokenizer's own pattern; its classes of characters are read off
the library, as Unicode versions differ. The automaton's arcs are spelled in bytes by a trie of
the tokens. Every beginning of a word has exactly one accepted path, so the walk keeps one state
for each place of a word and goes on from there along the trie; where the trie has a token and the
state its arc, that token's place is reached. Many words go through the tables at once as arrays;
words over LONG bytes one at a time, in time proportional to their length. Each different word is
walked once by a worker, until WORDS_BYTES of words are held. Decoding emits the bytes of arcs.

Scale. No shuffle. The tables are compiled once on the driver, as their size hangs on the vocabulary
alone, and broadcast compressed (a few MB); texts go through in slices of a few MB.

Defined cases: a null or empty text has no ids and is decoded as empty. Strings of added tokens are
those tokens' ids, as the library has it. Repeated rows are encoded each for itself, a null doc_id is
kept. Ids without a token, and null ids, decode to nothing; bytes that are no UTF-8 become U+FFFD.
An empty table gives no rows. Tokenizers that need anything besides (normalizers, prefix spaces,
byte fallback, a token of two merges) are refused with a ValueError.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as bl
from . import textkit as tk

#: Bytes of different words (with their ids) that a worker holds; bytes of a word that is walked alone; words walked at once.
WORDS_BYTES, LONG, TOGETHER = 48 << 20, 48, 1 << 15
#: Classes of characters: letters, numbers, other signs, white space, the end of a text.
LETTER, NUMBER, SIGN, WHITE, END = range(5)


def byte_characters() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte, and the byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Automaton:
    """States, arcs and labels of all tokens, with the trie that spells them."""

    def __init__(self, labels: list[bytes], state: np.ndarray, lacks: np.ndarray, trie: tuple[np.ndarray, ...], classes: np.ndarray, added: list[tuple[str, int]]):
        self.labels, self.state, self.lacks, self.classes, self.added = labels, state, lacks, classes, added
        self.slots, self.nodes, self.token, self.shift = trie[0], trie[1], trie[2], np.uint32(32 - (len(trie[0]) - 1).bit_length())
        self.length = np.fromiter(map(len, labels), np.int64, len(labels))
        self.label_bytes = np.frombuffer(b"".join(labels), np.uint8)
        self.label_at = np.append(0, np.cumsum(self.length))

    # -- arcs ---------------------------------------------------------------------------------

    def step(self, key: np.ndarray) -> np.ndarray:
        """Trie nodes reached by keys (node << 8 | byte), or -1."""
        mask = np.uint32(len(self.slots) - 1)
        at = (key * np.uint32(0x9E3779B1)) >> self.shift
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            held = self.slots[at]
            hit = held == key
            out[left[hit]] = self.nodes[at[hit]]
            more = ~hit & (held != np.uint32(0xFFFFFFFF))
            left, key, at = left[more], key[more], (at[more] + np.uint32(1)) & mask
        return out

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        return (self.lacks[token, state >> 3] >> (state & 7).astype(np.uint8)) & 1 == 0

    # -- encoding -------------------------------------------------------------------------------

    def walk_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many of each)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        count = np.zeros(len(words), np.int64)
        parts: dict[int, list[int]] = {}
        pieces = []
        for k in np.flatnonzero(sizes > LONG).tolist():
            parts[k] = self.walk(words[k])
            count[k] = len(parts[k])
        short = np.flatnonzero(sizes <= LONG)
        short = short[np.argsort(-sizes[short], kind="stable")]
        for a in range(0, len(short), TOGETHER):
            some = short[a : a + TOGETHER]
            ids, n = self._together([words[k] for k in some.tolist()], sizes[some])
            count[some] = n
            pieces.append((some, ids, n))
        first = np.append(0, np.cumsum(count))
        out = np.zeros(first[-1], np.int32)
        for some, ids, n in pieces:
            at, _ = tk.expand(first[some], n)
            out[at] = ids
        for k, ids in parts.items():
            out[first[k] : first[k + 1]] = ids
        return out, count

    def _together(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words by falling length, all at once: place by place, and from each place along the trie."""
        wide, n = int(sizes[0]) if len(sizes) else 0, len(words)
        text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(n, wide) if wide else np.zeros((n, 0), np.uint8)
        by = np.full((n, wide + 1), -1, np.int32)
        active = np.searchsorted(-sizes, -np.arange(wide + 1), "left")  # words longer than each place come first
        for at in range(wide):
            who = np.arange(active[at])
            state = self.state[by[: active[at], at]] if at else np.zeros(len(who), np.int32)
            node, to = np.zeros(len(who), np.int32), at
            while len(who):
                node = self.step(node.astype(np.uint32) << np.uint32(8) | text[who, to])
                go = node >= 0
                who, node, state = who[go], node[go], state[go]
                to += 1
                token = self.token[node]
                ends = np.flatnonzero(token >= 0)
                ends = ends[self.has_arc(state[ends], token[ends])]
                by[who[ends], to] = token[ends]
                go = sizes[who] > to
                who, node, state = who[go], node[go], state[go]
        at, row, steps = sizes.copy(), np.arange(n), []
        while len(row := row[at[row] > 0]):
            token = by[row, at[row]]
            steps.append((row, token))
            at[row] -= self.length[token]
        if not steps:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        rows, tokens = np.concatenate([r for r, _ in steps[::-1]]), np.concatenate([t for _, t in steps[::-1]])
        return tokens[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=n)

    @functools.cached_property
    def _arcs(self) -> dict[int, int]:
        have = self.slots != np.uint32(0xFFFFFFFF)
        return dict(zip(self.slots[have].tolist(), self.nodes[have].tolist(), strict=True))

    def walk(self, word: bytes) -> list[int]:
        """Ids of one word of any length."""
        arcs, token_of, state_of, lacks = self._arcs, self.token, self.state, self.lacks
        n = len(word)
        by = np.full(n + 1, -1, np.int32)
        for at in range(n):
            state = int(state_of[by[at]]) if at else 0
            cell, bit = state >> 3, state & 7
            node, to = 0, at
            while to < n:
                node = arcs.get(node << 8 | word[to], -1)
                if node < 0:
                    break
                to += 1
                token = token_of[node]
                if token >= 0 and not lacks[token, cell] >> bit & 1:
                    by[to] = token
        out, at = [], n
        while at:
            out.append(int(by[at]))
            at -= int(self.length[by[at]])
        return out[::-1]

    # -- words ----------------------------------------------------------------------------------

    def word_ends(self, chars: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Ends of the words of all texts. chars: code points, with one more at each of `ends`, the texts' ends, which belongs to no text."""
        kind = self.classes[chars]
        kind[ends] = END
        n = len(kind)
        start = np.ones(n, bool)  # of a run of one class
        start[1:] = kind[1:] != kind[:-1]
        run = np.flatnonzero(start)
        then = np.append(run[1:], n)
        of = kind[run]
        # White space ahead of something else parts with its last character, which a space gives to what follows.
        last = then[of == WHITE] - 1
        follows = np.append(kind, END)[last + 1] != END
        start[last[follows]] = True
        space = last[follows & (chars[last] == 32)]
        start[space + 1] = False
        # An apostrophe alone, without a space ahead, takes the letters of a contraction.
        quote = run[(of == SIGN) & (then - run == 1)]
        quote = quote[(chars[quote] == 39) & start[quote]]
        if len(quote):
            a, b = (np.append(chars, [0, 0])[quote + k] for k in (1, 2))
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
            start[quote[one | two] + 1] = False
            for q, long in ((quote[one], 2), (quote[two & ~one], 3)):
                after = q + long
                after = after[after < n]
                start[after] |= kind[after] == LETTER
        return np.append(np.flatnonzero(start)[1:], n)


class Words(dict):
    """Numbers of words, given out as they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Encoder:
    """Ids of texts by way of their different words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.special = re.compile("|".join(re.escape(s) for s, _ in sorted(automaton.added, key=lambda a: -len(a[0]))) or r"(?!)")
        self.special_ids = dict(automaton.added)
        self.reset()

    def reset(self) -> None:
        self.words, self.ids, self.ends, self.held = Words(), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64), 0

    def _learn(self, known: int) -> None:
        total = len(self.words)
        if total == known:
            return
        new = [w.encode() for w in islice(self.words, known, None)]
        got, n = self.automaton.walk_all(new)
        have = int(self.ends[known])
        ends = have + np.cumsum(n)
        for name, need in (("ids", int(ends[-1])), ("ends", total + 1)):
            a = getattr(self, name)
            if len(a) < need:
                setattr(self, name, np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)]))
        self.ids[have : ends[-1]] = got
        self.ends[known + 1 : total + 1] = ends
        self.held += sum(map(len, new)) + 120 * len(new) + 4 * len(got)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many of each)."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if self.held > WORDS_BYTES:
            self.reset()
        parts, owner, special = texts, None, []
        if any(s in t for s in self.special_ids for t in texts):
            parts, owner = [], []
            for k, t in enumerate(texts):
                at = 0
                for m in self.special.finditer(t):
                    parts += [t[at : m.start()], ""]
                    special.append((len(parts) - 1, self.special_ids[m.group()]))
                    owner += [k, k]
                    at = m.end()
                parts.append(t[at:])
                owner.append(k)
        text = "\n".join(parts) + "\n"
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        known = len(self.words)
        stop = self.automaton.word_ends(chars, ends)
        first = np.append(0, stop[:-1])
        real = ~np.isin(first, ends, assume_unique=True)
        first, stop = first[real], stop[real]
        number = self.words.__getitem__
        code = np.fromiter((number(text[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)), np.int64, len(first))
        self._learn(known)
        size = self.ends[code + 1] - self.ends[code]
        at, _ = tk.expand(self.ends[code], size)
        ids = self.ids[at]
        count = np.diff(np.append(0, np.append(0, np.cumsum(size))[np.searchsorted(first, ends)]))
        if owner is not None:
            where = np.cumsum(count)
            rows = np.array([k for k, _ in special])
            ids = np.insert(ids, where[rows], [i for _, i in special])
            count[rows] += 1
            count = np.bincount(np.array(owner), weights=count, minlength=len(texts)).astype(np.int64)
        return ids, count

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of ids: the arcs' labels one after the other."""
        a = self.automaton
        ok = (ids >= 0) & (ids < len(a.labels))
        known = np.where(ok, ids, 0)
        size = np.where(ok, a.length[known], 0)
        at, _ = tk.expand(a.label_at[known], size)
        raw = a.label_bytes[at].tobytes()
        cut = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))].tolist()
        return [raw[i:j].decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:], strict=True)]


# -- compiling --------------------------------------------------------------------------------------


def gadgets(first: list[int], merges: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(state that each token leads to, bits of the arcs that are lacking: tokens x states), by one gadget a merge.

    first: tokens of one byte; merges: (a, b, c) in their order; size: number of ids.
    """
    state, users, states = np.full(size, -1, np.int32), [len(first) + 1], 1
    state[first] = 0
    lacks = np.zeros((size, 256), np.uint8)
    high = max(first) + 1  # tokens from here on have no arc yet

    def copied(q: int) -> int:
        nonlocal states, lacks
        new = states
        states += 1
        if states > 8 * lacks.shape[1]:
            lacks = np.concatenate([lacks, np.zeros((size, lacks.shape[1] // 2), np.uint8)], axis=1)
        lacks[:high, new >> 3] |= ((lacks[:high, q >> 3] >> (q & 7)) & 1) << (new & 7)
        users.append(1)
        users[q] -= 1
        return new

    for a, b, c in merges:
        q, high = int(state[a]), max(high, c + 1)
        if q < 0 or state[b] < 0 or state[c] >= 0:
            raise ValueError("a merge before its parts, or a token of two merges")
        if lacks[b, q >> 3] >> (q & 7) & 1:  # a and b never meet: the token has no arc
            state[c], lacks[c] = 0, 255
            users[0] += 1
            continue
        to = q if a == b else int(state[b])
        lacks[c] = lacks[a]
        state[c] = to
        users[to] += 1
        if users[q] > 1:
            state[a] = q = copied(q)
        lacks[b, q >> 3] |= 1 << (q & 7)
        if a == b:  # without an arc a, the copy has no arc c either
            lacks[c, q >> 3] |= 1 << (q & 7)
    return state, lacks[:, : (states + 7) // 8].copy()


def spell(labels: list[bytes], wanted: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A trie of the tokens as a table: (keys node << 8 | byte in their slots, nodes there, token of each node or -1)."""
    arcs: dict[int, int] = {}
    token = [-1]
    for t in wanted:
        node = 0
        for byte in labels[t]:
            key = node << 8 | byte
            node = arcs.get(key)
            if node is None:
                node = arcs[key] = len(token)
                token.append(-1)
        token[node] = t
    size = 1 << (2 * len(arcs)).bit_length()
    shift = 32 - (size - 1).bit_length()
    slots, nodes = np.full(size, 0xFFFFFFFF, np.uint32), np.zeros(size, np.int32)
    for key, node in arcs.items():
        at = (key * 0x9E3779B1 & 0xFFFFFFFF) >> shift
        while slots[at] != 0xFFFFFFFF:
            at = (at + 1) & (size - 1)
        slots[at], nodes[at] = key, node
    return slots, nodes, np.array(token, np.int32)


def character_classes() -> np.ndarray:
    """The class of every code point, as the library's patterns take it."""
    from tokenizers import Regex, pre_tokenizers

    out = np.full(0x110000, SIGN, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], np.int64)
    text = "".join(map(chr, points.tolist()))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        other = [place for _, place in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text)]
        out[points[~tk.cover(np.array([a for a, _ in other]), np.array([b for _, b in other]), len(points))]] = kind
    return out


def compile_tokenizer(path: str) -> bytes:
    """The tables of a byte-level BPE tokenizer file, compressed."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, pre = given["model"], given["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or given["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or (given["decoder"] or {}).get("type") != "ByteLevel":
        raise ValueError(f"{path} is no plain byte-level BPE tokenizer")
    added = given["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError(f"{path} has added tokens with rules of their own")
    vocab, byte_of = model["vocab"], byte_characters()
    size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
    labels = [b""] * size
    for word, t in vocab.items():
        labels[t] = bytes(byte_of[c] for c in word)
    first = [t for word, t in vocab.items() if len(word) == 1]
    if len(first) != 256:
        raise ValueError(f"{path} lacks bytes")
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    state, lacks = gadgets(first, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], size)
    trie = spell(labels, np.flatnonzero(state >= 0).tolist())
    for t in added:
        labels[t["id"]] = t["content"].encode()
    classes = character_classes()
    names = json.dumps([(t["content"], t["id"]) for t in added]).encode()
    lengths = np.fromiter(map(len, labels), np.int32, size)
    tables = [np.frombuffer(b"".join(labels), np.uint8), lengths, state, np.array(lacks.shape, np.int64), *trie, classes, np.frombuffer(names, np.uint8)]
    return bl.pack(*tables) + b"TABLE" + zstandard.ZstdCompressor(level=3).compress(lacks.tobytes())


def automaton(tables: bytes) -> Automaton:
    head, _, bits = tables.partition(b"TABLE")
    raw, lengths, state, shape, slots, nodes, token, classes, names = bl.unpack(head)
    at = np.append(0, np.cumsum(lengths)).tolist()
    raw = raw.tobytes()
    lacks = np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), np.uint8).reshape(shape.tolist())
    return Automaton([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], state, lacks, (slots, nodes, token), classes, [tuple(x) for x in json.loads(names.tobytes())])


@functools.cache
def compiled(path: str) -> bytes:
    """compile_tokenizer(), once in this process."""
    return compile_tokenizer(path)


_HELD: dict[int, Encoder] = {}


def _encoder(tables) -> Encoder:
    """The encoder of this worker process; its words serve all tasks of the process."""
    raw = tables.value
    name = hash(raw)
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = Encoder(automaton(raw))
    return _HELD[name]


def _with(rb: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rb.columns, column], names=[*rb.schema.names, name])


def _texts(rb: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, list[str]]]:
    for a, b, buf, off in tk.text_slices(rb, column, 1 << 20):
        raw, cut = buf.tobytes(), off.tolist()
        yield a, b, [raw[i:j].decode("utf-8", "replace") for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _encode(tables, column: str, out: str):
    def run(stream):
        encoder = _encoder(tables)
        for rb in stream:
            for a, b, texts in _texts(rb, column):
                ids, count = encoder.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids, pa.int32()))
                yield _with(rb.slice(a, b - a), out, lists)
        bl.give_back()

    return run


def _decode(tables, column: str, out: str):
    def run(stream):
        encoder = _encoder(tables)
        for rb in stream:
            at = rb.schema.get_field_index(column)
            sizes = np.asarray(rb.column(at).value_lengths().fill_null(0), np.int64)
            for a, b in tk.slices(np.append(0, np.cumsum(sizes)), 1 << 18):
                part, count = rb.slice(a, b - a), sizes[a:b]
                lists = part.column(at)
                ids = np.asarray(lists.flatten().fill_null(-1), np.int64)
                yield _with(part, out, pa.array(encoder.decode(ids, count), pa.string()))
        bl.give_back()

    return run


_SENT: dict[tuple[str, str], Broadcast] = {}


def _tables(df: DataFrame, path: str) -> Broadcast:
    """The tables, sent once to an application's executors."""
    sc = df.sparkSession.sparkContext
    name = sc.applicationId, path
    if name not in _SENT:
        _SENT[name] = sc.broadcast(compiled(path))
    return _SENT[name]


def _extended(df: DataFrame, work, path: str, column: str, out: str, kind: str) -> DataFrame:
    """The rows with one more column. Names may hold dots or be the same, so they are numbers meanwhile."""
    names = [f"c{k}" for k in range(len(df.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True))
    return df.toDF(*names).mapInArrow(work(_tables(df, path), names[df.columns.index(column)], "out"), f"{kinds}, out {kind}").toDF(*df.columns, out)


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids") -> DataFrame:
    """The rows with their texts' ids as one more column, an array of int."""
    return _extended(docs, _encode, tokenizer, text, out, "array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text of their ids as one more column."""
    return _extended(encoded, _decode, tokenizer, ids, out, "string")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    ids = encode(narrow, tokenizer).drop("text")
    return decode(ids, tokenizer).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha256(F.concat_ws(",", F.col("ids").cast("array<string>"))).alias("ids_sha256"),
        _sha256(F.col("decoded")).alias("decoded_sha256"),
    )
