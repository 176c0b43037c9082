"""Token counts by a compiled finite-state tokenizer.

A byte-pair tokenizer file (lower-casing words, with word ends) is compiled
into two deterministic transducers.  The *splitter* reads classes of
characters and marks where words begin.  The *counter* reads the bytes of a
word; every transition carries the number of tokens it emits, net, so the sum
along a word's path is the word's token count.  Nothing is ever merged pair by
pair over a text.

Splitter.  A text is cut into chunks of ``CHUNK`` characters.  Each chunk is
run from every state at once, which gives its state map (state before ->
state after); the maps compose by a parallel prefix scan, which gives the
state before every chunk, and a second run from those states emits the marks.

Counter.  A sequence of tokens is what merging makes of a string exactly if
every token, and every pair of neighbours, is what merging makes of its own
string.  So after each byte there is one last token, found among the tokens
that end there, and the state is bounded: per start of a token that may still
be growing, the place in the token trie, the token before it, and how many
tokens the count has moved since.  States are made when first met.

Rows: null and empty texts have 0 bytes and 0 tokens; repeated rows are
counted one by one; a null ``doc_id`` is kept; columns of other names pass
through.  A text of any length is read in slices that end at white space.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Characters of a chunk, and of a slice that is held at once.
CHUNK, SLICE = 256, 1 << 20
#: Entries of the counter's caches; a full cache is emptied, which changes no result.
CACHE = 500_000
LONG_WORD = 64
#: Classes of characters, and the splitter's states.
SPACE, DIGIT, OTHER, QUOTE, S_T_M_D, R, V, L, E, LETTER, END = range(11)
BETWEEN, WORD, MARKS, QUOTED, Q_R, Q_V, Q_L = range(7)
N_CLASSES, N_STATES = 11, 7
CLOSED = 0x110000           # stands for the end of a text: no character
HERE, BEFORE = 1, 2         # outputs: a word begins at this character, at the one before


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next states and outputs, by ``state * N_CLASSES + class``."""
    nxt = np.zeros(N_STATES * N_CLASSES, np.uint8)
    out = np.zeros(N_STATES * N_CLASSES, np.uint8)
    letters = (S_T_M_D, R, V, L, E, LETTER)

    def put(state, classes, to, mark):
        for c in classes:
            nxt[state * N_CLASSES + c], out[state * N_CLASSES + c] = to, mark

    # after "'r", "'v", "'l" that were no contraction, the letter before began a word
    for state, retro in ((BETWEEN, 0), (WORD, 0), (MARKS, 0), (QUOTED, 0), (Q_R, BEFORE), (Q_V, BEFORE), (Q_L, BEFORE)):
        put(state, (SPACE, END), BETWEEN, retro)
        put(state, (DIGIT,), BETWEEN, HERE | retro)
        put(state, (OTHER,), MARKS, HERE | retro)
        put(state, (QUOTE,), QUOTED, HERE | retro)
        put(state, letters, WORD, HERE if state in (BETWEEN, MARKS, QUOTED) else retro)
    put(MARKS, (OTHER, QUOTE), MARKS, 0)
    put(QUOTED, (OTHER, QUOTE), MARKS, 0)
    put(QUOTED, (S_T_M_D,), BETWEEN, 0)
    put(QUOTED, (R,), Q_R, 0)
    put(QUOTED, (V,), Q_V, 0)
    put(QUOTED, (L,), Q_L, 0)
    put(Q_R, (E,), BETWEEN, 0)
    put(Q_V, (E,), BETWEEN, 0)
    put(Q_L, (L,), BETWEEN, 0)
    return nxt, out


def compose(maps: np.ndarray) -> np.ndarray:
    """State before each chunk, from the chunks' state maps ``[states,
    chunks]``, by an inclusive prefix scan of map composition."""
    scan = maps.copy()
    step = 1
    while step < scan.shape[1]:
        scan[:, step:] = np.take_along_axis(scan[:, step:], scan[:, :-step].copy(), axis=0)
        step *= 2
    return np.concatenate([[BETWEEN], scan[BETWEEN, :-1]]).astype(np.uint8)


def word_starts(classes: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Positions where words begin, ascending."""
    nxt, out = table
    n = len(classes)
    chunks = -(-n // CHUNK)
    lanes = np.full(chunks * CHUNK, END, np.uint8)
    lanes[:n] = classes
    lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
    maps = np.repeat(np.arange(N_STATES, dtype=np.uint8)[:, None], chunks, axis=1)
    for row in lanes:
        maps = nxt.take(maps * np.uint8(N_CLASSES) + row)
    state = compose(maps)
    marks = np.empty_like(lanes)
    for k, row in enumerate(lanes):
        at = state * np.uint8(N_CLASSES) + row
        out.take(at, out=marks[k])
        state = nxt.take(at)
    flat = marks.T.reshape(-1)[:n]
    starts = (flat & HERE) > 0
    starts[:-1] |= (flat[1:] & BEFORE) > 0
    return np.flatnonzero(starts)


class Counter(dict):
    """Token count of a word; made from a tokenizer file's merges.

    A state is a dict: byte (plus 256 for a word's last) -> (next state, net
    tokens), and under ``LIVE`` the tokens that may still be growing.
    """

    LIVE = -1

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        chars = byte_characters()
        first = [vocab[c] for c in chars] + [vocab[c + suffix] for c in chars]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        spell = {t: (i,) for i, t in enumerate(first)}
        for r, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            a, b, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((a, b), r)
            if whole not in spell:
                spell[whole], self.parts[whole] = spell[a] + spell[b], (a, b, r)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        for token, spelled in spell.items():
            node = 0
            for s in spelled:
                if s not in self.trie[node]:
                    self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                node = self.trie[node][s]
            self.token_at[node] = token
        self.alone: dict[int | None, bool] = {None: True}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        root = ((0, None, 0),)
        self.start = {self.LIVE: root}
        self.states, self.arcs = {root: self.start}, 0

    def edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one end (0 left, 1 right) of a token while
        it is being merged, first to last, with the ranks that make them."""
        out = []
        while token in self.parts:
            out.append((token, self.parts[token][2]))
            token = self.parts[token][side]
        return [(token, -1), *reversed(out)]

    def apart(self, left: int, right: int, until: int) -> bool:
        """True if no merge joins across the border of two neighbours before
        both are whole and rank ``until`` is reached.  Merges happen in the
        order of rank, and at one rank from the left."""
        x, y = self.edge(left, 1), self.edge(right, 0)
        i = j = 0
        never = 1 << 60
        while True:
            nx = x[i + 1][1] if i + 1 < len(x) else never
            ny = y[j + 1][1] if j + 1 < len(y) else never
            across = self.rank.get((x[i][0], y[j][0]), never)
            if across < nx and across <= ny and across < until:
                return False
            if nx == ny == never:
                return True
            i, j = (i + 1, j) if nx <= ny else (i, j + 1)

    def whole(self, token: int | None) -> bool:
        """Is the token what merging makes of its own string?"""
        ok = self.alone.get(token)
        if ok is None:
            a, b, r = self.parts.get(token, (None, None, -1))
            ok = a is None or (self.whole(a) and self.whole(b) and self.apart(a, b, r))
            self.alone[token] = ok
        return ok

    def fits(self, before: int | None, token: int) -> bool:
        if before is None or not self.whole(token):
            return self.whole(token)
        ok = self.pairs.get((before, token))
        if ok is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            ok = self.pairs[before, token] = self.apart(before, token, 1 << 59)
        return ok

    def arc(self, state: dict, symbol: int) -> tuple[dict, int]:
        """Next state and net tokens of a transition that was not met before."""
        grown, last, net = [], None, 0
        for node, before, moved in state[self.LIVE]:
            node = self.trie[node].get(symbol)
            if node is None:
                continue
            token = self.token_at.get(node)
            if token is not None and last is None and self.fits(before, token):
                last, net = token, 1 - moved
            if self.trie[node]:
                grown.append((node, before, moved))
        key = tuple((node, before, moved + net) for node, before, moved in grown) + ((0, last, 0),)
        if key not in self.states:
            self.states[key] = {self.LIVE: key}
        made = state[symbol] = self.states[key], net
        self.arcs += 1
        return made

    def count(self, word: str) -> int:
        if self.arcs >= CACHE:
            self.reset()
        data = word.encode()
        state, total = self.start, 0
        for s in data[:-1]:
            state, net = state.get(s) or self.arc(state, s)
            total += net
        state, net = state.get(256 + data[-1]) or self.arc(state, 256 + data[-1])
        return total + net

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= LONG_WORD:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Compiled:
    """Both transducers, and the tables of characters, of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.check(spec)
        library = Tokenizer.from_file(path)
        self.normalizer, self.pre = library.normalizer, library.pre_tokenizer
        self.specials = [t["content"] for t in spec["added_tokens"]]
        model = spec["model"]
        self.counter = Counter(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.table = splitter()
        self.lower = np.arange(CLOSED + 1, dtype=np.uint32)
        self.lower[CLOSED] = 32
        self.kind = np.full(CLOSED + 1, 255, np.uint8)
        self.kind[CLOSED] = END
        self.odd = np.zeros(CLOSED + 1, bool)

    @staticmethod
    def check(spec: dict) -> None:
        """The splitter is written for one family of files; refuse others."""
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        ok = (model["type"] == "BPE" and model["end_of_word_suffix"] and not model["ignore_merges"] and not model["dropout"]
              and not model["continuing_subword_prefix"]
              and [n["type"] for n in norm["normalizers"]] == ["NFC", "Replace", "Lowercase"]
              and pre["pretokenizers"][0]["pattern"] == {"Regex": pattern}
              and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec["added_tokens"]))
        if not ok:
            raise ValueError("not a lower-casing byte-level BPE file with word ends")

    def learn(self, points: np.ndarray) -> None:
        """Lower case and class of characters not met before, as the library has them."""
        for p in np.unique(points[self.kind[points] == 255]).tolist():
            c = chr(p)
            low = self.normalizer.normalize_str(c)
            if low != c and len(low) == 1:
                self.lower[p] = ord(low)
            self.odd[p] = len(low) != 1
            seen = low if len(low) == 1 else c
            if seen == " " or not self.pre.pre_tokenize_str(seen):
                self.kind[p], self.lower[p] = SPACE, 32
            elif seen in "stmd":
                self.kind[p] = S_T_M_D
            elif seen in "'rvle":
                self.kind[p] = {"'": QUOTE, "r": R, "v": V, "l": L, "e": E}[seen]
            elif len(self.pre.pre_tokenize_str("!" + seen)) == 1:
                self.kind[p] = OTHER
            else:
                self.kind[p] = LETTER if len(self.pre.pre_tokenize_str("a" + seen)) == 1 else DIGIT

    def points(self, text: str) -> tuple[np.ndarray, int]:
        """Characters of a text that needs more than a table: special strings
        count one token each and end what comes before; the rest is brought
        to composed lower case by the library."""
        parts, found, at = [], 0, 0
        while True:
            hits = [(i, -len(s), s) for s in self.specials if (i := text.find(s, at)) >= 0]
            end, _, s = min(hits, default=(len(text), 0, ""))
            parts.append(np.frombuffer(self.normalizer.normalize_str(text[at:end]).encode("utf-32-le"), np.uint32))
            if not hits:
                return np.concatenate(parts), found
            parts.append(np.array([CLOSED], np.uint32))
            found, at = found + 1, end + len(s)

    def plain(self, text: str, points: np.ndarray) -> bool:
        return not (self.odd[points].any() or any(s in text for s in self.specials)
                    or not unicodedata.is_normalized("NFC", text))

    def slices(self, points: np.ndarray) -> Iterator[np.ndarray]:
        """Stretches of about ``SLICE`` characters, cut only at white space or ends."""
        at = 0
        while len(points) - at > SLICE:
            for end in range(at + SLICE, len(points) + SLICE, SLICE):
                stretch = points[max(at, end - SLICE):end]
                breaks = np.flatnonzero((self.kind[stretch] == SPACE) | (self.kind[stretch] == END))
                if len(breaks):
                    end = max(at, end - SLICE) + int(breaks[-1]) + 1
                    break
                if end >= len(points):
                    end = len(points)
                    break
            yield points[at:end]
            at = end
        if at < len(points):
            yield points[at:]

    def words(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of a slice begin, and each word's token count."""
        starts = word_starts(self.kind[points], self.table)
        spaced = np.insert(self.lower[points], starts, 32).tobytes().decode("utf-32-le")
        found = [w for w in spaced.split(" ") if w]
        return starts, np.fromiter(map(self.counter.__getitem__, found), np.int64, len(found))

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Token counts of a batch of texts."""
        rows, pieces = [], []
        total = np.zeros(len(texts), np.int64)
        held = 0

        def flush():
            nonlocal held
            if pieces:
                joined = np.concatenate(pieces)
                ends = np.cumsum([len(p) for p in pieces])
                off = 0
                for s in self.slices(joined):
                    starts, n = self.words(s)
                    np.add.at(total, np.asarray(rows)[np.searchsorted(ends, starts + off, side="right")], n)
                    off += len(s)
                rows.clear()
                pieces.clear()
                held = 0

        close = np.array([CLOSED], np.uint32)
        for i, text in enumerate(texts):
            if not text:
                continue
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            self.learn(points)
            if not text.isascii() or "<|" in text:
                if not self.plain(text, points):
                    points, found = self.points(text)
                    total[i] += found
                    self.learn(points)
            rows.append(i)
            pieces.append(np.concatenate([points, close]))
            held += len(points)
            if held >= SLICE:
                flush()
        flush()
        return total


_compiled: dict[str, Compiled] = {}


def compiled(path: str) -> Compiled:
    """One compilation per worker process."""
    if path not in _compiled:
        _compiled[path] = Compiled(path)
    return _compiled[path]


def with_token_counts(docs: DataFrame, tokenizer: str, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with one more column ``name``: the tokens of ``text`` as the
    library counts them for the file ``tokenizer``, without added special
    tokens.  The file is sent to the executors."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(tokenizer)
    base = tokenizer.rsplit("/", 1)[-1]
    schema = StructType([StructField(f"__c{i}", f.dataType, True) for i, f in enumerate(docs.schema.fields)]
                        + [StructField("__n", LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(SparkFiles.get(base))
        for b in batches:
            n = pa.array(machine.counts(b.column(at).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, n], names=[*b.schema.names, "__n"])

    numbered = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, schema).toDF(*docs.columns, name)


def byte_length(text: Column) -> Column:
    """UTF-8 bytes of a text; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
