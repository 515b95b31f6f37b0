"""Token counts by finite-state transducer, for byte-level BPE with the usual word pattern.

Two deterministic machines are compiled from the tokenizer file.

* `Splitter` reads classes of characters and cuts a text into the pieces that BPE works on.
* `Bpe` reads bytes.  Each transition is annotated with the change in the number of tokens, so
  that the sum along a path is the token count of what was read.  A state is what the future can
  depend on: for every suffix read that may still begin a token, the token before that suffix and
  the count before it, relative to the count now.  A pair of tokens may stand side by side if BPE
  gives back that pair for their concatenation, and of all ways to end a prefix in a token exactly
  one may follow what is before it.  Equal states are merged and built when first reached; the
  table is dropped when it has `max_states`, as lazy automata do.

Long texts are cut into chunks, which are rows of their own.  Both machines return to their start
whatever they have read where white space follows a word and where the class of characters changes,
so a chunk that begins at such a place has a map of one entry.  Where a chunk has to begin inside a
run of one class the state before it is unknown: its map then goes from each state that a run from
some place before it leads to, to the state at its end and the count on the way; states that meet
go on as one.  `compose` puts neighbouring maps together, many at a time and in rounds, as the
upward half of a prefix scan; only the total is wanted.  A text whose true state is in no map is
counted from its start instead, so counts are exact in every case.
"""

from __future__ import annotations

import json
import re
import sys
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from tokenizers import pre_tokenizers

from tessera.llm.rows import set_aside
from tessera.session import broadcast_if, materialize

#: White space as the word pattern's library sees it.
SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The endings that the word pattern cuts off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CHUNK = 1 << 16  # characters of a row of a long text
PART = 64  # chunks that are cut out of a text together
BACK, WINDOW, INSIDE = 1024, 128, 8  # characters: seen before a chunk; on each side of a border; of one class around a cut in a run
PHASES = 128  # places that guesses start from
TOGETHER = 64  # maps composed by one row
REMEMBERED = 64
START = "0,-1,0"


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """Character -> byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class State:
    """ends: for each suffix that may still begin a token its place in the trie, the token before it, and the count before it less the count now; in one flat tuple."""

    __slots__ = ("ends", "next")

    def __init__(self, ends: tuple[int, ...]):
        self.ends, self.next = ends, {}


class Bpe:
    """The lazily built transducer over bytes.  Tokens are numbered by their place in the trie of all tokens."""

    def __init__(self, tokens: list[bytes], merges: dict[tuple[bytes, bytes], int], max_states: int = 200_000):
        self.child: dict[int, int] = {}
        self.is_token, self.max_states = bytearray(1), max_states
        number = {t: self._place(t) for t in tokens}
        for n in number.values():
            self.is_token[n] = 1
        self.merges = {(number[a], number[b]): rank for (a, b), rank in merges.items()}
        self.made = {number[a + b]: (rank, (number[a], number[b])) for (a, b), rank in reversed(merges.items())}
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[int, int], bool] = {}
        self._restart()

    def _place(self, data: bytes) -> int:
        at = 0
        for byte in data:
            key = at << 8 | byte
            if key not in self.child:
                self.child[key] = len(self.is_token)
                self.is_token.append(0)
            at = self.child[key]
        return at

    def _restart(self) -> None:
        self.start = State((0, -1, 0))
        self.states = {self.start.ends: self.start}

    def _edge(self, token: int, left: bool) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of a token while BPE builds it, each with the rank that ends it."""
        known = self.edges[left]
        if token not in known:
            if token not in self.made:
                known[token] = [(token, sys.maxsize)]
            else:
                rank, pair = self.made[token]
                below = self._edge(pair[0 if left else 1], left)
                known[token] = [*below[:-1], (below[-1][0], rank), (token, sys.maxsize)]
        return known[token]

    def _adjacent(self, a: int, b: int) -> bool:
        """Does no merge cross the border of a and b while both are built?

        A pair across it is merged if its rank comes before both of its parts are used up; at the
        same rank the pair further left goes first.
        """
        if len(self.fits) > 4 * self.max_states:
            self.fits.clear()
        rank, right = self.merges.get, self._edge(b, True)
        fits = True
        for p, p_end in self._edge(a, False):
            for q, q_end in right:
                r = rank((p, q))
                if r is not None and r < p_end and r <= q_end:
                    fits = False
        self.fits[a, b] = fits
        return fits

    def _step(self, state: State, byte: int) -> tuple[State, int]:
        if len(self.states) >= self.max_states:
            self._restart()
        child, is_token, fits = self.child, self.is_token, self.fits
        grown, token, delta = [], 0, 0
        flat = iter(state.ends)
        for place, before, count in zip(flat, flat, flat, strict=True):
            now = child.get(place << 8 | byte)
            if now is None:
                continue
            if not token and is_token[now]:
                ok = before < 0 or fits.get((before, now))
                if ok or ok is None and self._adjacent(before, now):
                    token, delta = now, count + 1
            grown.append((now, before, count))
        ends = []
        for now, before, count in grown:
            ends += (now, before, count - delta)
        key = (*ends, 0, token, 0)
        following = self.states.get(key)
        if following is None:
            self.states[key] = following = State(key)
        state.next[byte] = found = (following, delta)
        return found

    def walk(self, state: State, data: bytes) -> tuple[State, int]:
        total = 0
        for byte in data:
            state, delta = state.next.get(byte) or self._step(state, byte)
            total += delta
        return state, total

    def walk_all(self, states: list[State], data: bytes) -> list[tuple[State, int]]:
        """The walk from each of the states; those that have come to the same state go on as one."""
        at, totals, owner = list(states), [0] * len(states), list(range(len(states)))
        ahead = [0] * len(states)  # of the owner's total
        for i in range(0, len(data), 64):
            part, seen = data[i : i + 64], {}
            for k in sorted(set(owner)):
                at[k], n = self.walk(at[k], part)
                totals[k] += n
                first = seen.setdefault(at[k].ends, k)
                if first != k:
                    for j, o in enumerate(owner):
                        if o == k:
                            owner[j], ahead[j] = first, ahead[j] + totals[k] - totals[first]
        return [(at[o], totals[o] + ahead[j]) for j, o in enumerate(owner)]

    def count(self, data: bytes) -> int:
        return self.walk(self.start, data)[1]


class Splitter:
    """Cuts one segment (white space, then none) into pieces, one character class at a time.

    The classes are the library's own: it is asked about each character once.
    """

    def __init__(self):
        self.classes: dict[str, str] = {}
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
        near = [chr(i) for i in range(0x250)]
        letters, digits = ("".join(re.escape(c) for c in near if self.kind(c) == k) for k in "LN")
        self.simple = re.compile("[\x00-&(-\u024f]+").fullmatch  # all but the apostrophe
        self.runs = re.compile(f"[{letters}]+|[{digits}]+|[^{letters}{digits}]+").findall

    def kind(self, char: str) -> str:
        if char not in self.classes:
            together = lambda other: len(self.library(other + char)) == 1  # noqa: E731  the library's own Unicode version decides
            self.classes[char] = "L" if together("a") else "N" if together("1") else "O"
        return self.classes[char]

    def pieces(self, space: str, word: str) -> list[str]:
        if not word:
            return [space]
        joined = space[-1:] == " "  # one plain space belongs to the word after it
        out = [s for s in (space[:-1], "" if joined else space[-1:]) if s]
        if self.simple(word):
            runs = self.runs(word)
            if joined:
                runs[0] = " " + runs[0]
            return out + runs
        at, fresh = 0, not joined  # fresh: an apostrophe here may begin an ending
        while at < len(word):
            ending = next((e for e in ENDINGS if word.startswith(e, at + 1)), None) if fresh and word[at] == "'" else None
            if ending:
                end = at + 1 + len(ending)
            else:
                kind, end = self.kind(word[at]), at + 1
                while end < len(word) and self.kind(word[end]) == kind:
                    end += 1
            out.append(word[at:end])
            at, fresh = end, True
        if joined:
            first = len(out) - 1 if len(out) == 1 else int(bool(space[:-1]))
            out[first] = " " + out[first]
        return out


class Counter(dict):
    """Counts tokens of texts.  As a mapping: segment -> count, of the last max_segments to twice as many."""

    def __init__(self, spec: str, max_segments: int = 400_000):
        made = json.loads(spec)
        alphabet, model = byte_alphabet(), made["model"]
        raw = lambda token: bytes(alphabet[c] for c in token)
        pre = made["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or made["normalizer"]:
            raise ValueError("only plain byte-level BPE tokenizers can be compiled")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = [t["content"] for t in made["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        tokens = [raw(t) for t in model["vocab"] if t not in self.special]
        self.bpe, self.splitter, self.max_segments = Bpe(tokens, merges), Splitter(), max_segments
        self.older: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.parts = re.compile(f"([{SPACES}]*)([^{SPACES}]*)")
        self.find = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+").findall
        self.space = re.compile(f"[{SPACES}]").match
        if any(len(t) > WINDOW // 2 for t in self.special):
            raise ValueError(f"special tokens may have {WINDOW // 2} characters")

    def __missing__(self, segment: str) -> int:
        count = self.older.get(segment)
        if count is None:
            count = self._segment(segment)
        if len(segment) <= REMEMBERED:
            if len(self) >= self.max_segments:
                self.older = dict(self)
                self.clear()
            self[segment] = count
        return count

    def _segment(self, segment: str) -> int:
        space, word = self.parts.match(segment).groups()
        return sum(self.known.get(piece) or self._count(piece) for piece in self.splitter.pieces(space, word))

    def _count(self, piece: str) -> int:
        count = self.bpe.count(piece.encode("utf-8", "replace"))
        if len(piece) <= REMEMBERED:
            if len(self.known) >= self.max_segments:
                self.known.clear()
            self.known[piece] = count
        return count

    def segments(self, text: str) -> int:
        return sum(map(self.__getitem__, self.find(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        plain = self.cut.split(text) if self.cut else [text]
        return len(plain) - 1 + sum(map(self.segments, plain))

    def _class(self, char: str) -> str:
        return "S" if self.space(char) else self.splitter.kind(char)

    def border(self, around: str) -> tuple[int, bool] | None:
        """Where to cut, from WINDOW characters on each side: place, and whether the machines restart there.

        None if no place will do.  Both neighbours see the same characters and so agree.
        """
        special = []
        for name in self.special:
            at = around.find(name)
            while at >= 0:
                special.append((at, at + len(name)))
                at = around.find(name, at + 1)
        edges = {p for a, b in special if not any(a < d and c < b and (a, b) != (c, d) for c, d in special) for p in (a, b)}
        kinds = [self._class(c) for c in around]
        places = range(WINDOW // 2, min(len(around) - INSIDE, WINDOW + WINDOW // 2))
        for p in places:
            # An ending is the only piece of two classes, and it has its apostrophe first.
            apart = kinds[p - 1] not in ("S", kinds[p]) and not (kinds[p] == "L" and around[p - 1] == "'")
            if (apart or p in edges) and not any(a < p < b for a, b in special):
                return p, True
        for p in places:
            if len(set(kinds[p - INSIDE : p + INSIDE])) == 1 and not any(a < p + INSIDE and p - INSIDE < b for a, b in special):
                return p, False
        return None

    def _run(self, text: str, start: int = 0) -> int:
        """Where the run of one class that has `start` in it ends."""
        kind, end = self._class(text[start]), start + 1
        while end < len(text) and self._class(text[end]) == kind:
            end += 1
        return end

    def _guesses(self, before: str) -> list[State]:
        """States that the end of `before`, inside a run, may be in: those of runs from places before it."""
        kind, first = self._class(before[-1]), len(before) - 1
        while first and self._class(before[first - 1]) == kind:
            first -= 1
        far = max(first, len(before) - BACK // 2)
        starts = {first, max(0, first - 1), *range(first, min(first + 3, len(before))), *range(far, min(far + PHASES, len(before)))}
        found = {}
        for at in sorted(starts):
            state = self.bpe.walk(self.bpe.start, before[at:].encode("utf-8", "replace"))[0]
            found[state.ends] = state
        return list(found.values())

    def state_map(self, window: str, lead: int, last: bool, chunk: int) -> dict[tuple[int, ...], tuple[tuple[int, ...], int]]:
        """State before a chunk -> state after it and the count; without an entry for states that nothing led to.

        The chunk has nominally `chunk` characters after the first `lead` of the window; WINDOW
        more follow it unless it is the last of its text.
        """
        begin, entered, end, closed = 0, True, len(window), True
        if lead:
            place = self.border(window[lead - WINDOW : lead + WINDOW])
            if place is None:
                return {}
            begin, entered = lead - WINDOW + place[0], place[1]
        if not last:
            place = self.border(window[lead + chunk - WINDOW : lead + chunk + WINDOW])
            if place is None:
                return {}
            end, closed = lead + chunk - WINDOW + place[0], place[1]
        bpe, content = self.bpe, window[begin:end]
        plain = self.cut.split(content) if self.cut else [content]
        run, through = "", False
        if not entered and plain[0]:
            to = self._run(plain[0])
            through = to == len(content) and not closed
            if to < len(plain[0]) and self.space(plain[0][0]):
                to -= 1  # the last space belongs to what follows
            run, plain[0] = plain[0][:to], plain[0][to:]
        total, after = len(plain) - 1 + sum(map(self.segments, plain[:-1])), bpe.start
        if closed or through:
            total += self.segments(plain[-1])
        else:
            *whole, open_ = self.find(plain[-1])
            *pieces, tail = self.splitter.pieces(*self.parts.match(open_).groups())
            total += sum(map(self.__getitem__, whole)) + sum(map(self._count, pieces))
            after, n = bpe.walk(bpe.start, tail.encode("utf-8", "replace"))
            total += n
        if entered:
            return {bpe.start.ends: (after.ends, total)}
        guesses = self._guesses(window[:begin])
        ways = bpe.walk_all(guesses, run.encode("utf-8", "replace"))
        return {g.ends: ((state if through else after).ends, n + total) for g, (state, n) in zip(guesses, ways, strict=True)}


@lru_cache(2)
def compiled(spec: str) -> Counter:
    """One compiled tokenizer for each Python worker."""
    return Counter(spec)


def token_counts(text: Column, path: str) -> Column:
    """Tokens of each whole text as a long; none in null.

    The tokenizer file (a fixed few MB) is read here, on the driver, and goes with the function.
    """
    with open(path, encoding="utf-8") as f:
        spec = f.read()

    @F.arrow_udf(T.LongType())
    def counted(texts: pa.Array) -> pa.Array:
        counter = compiled(spec)
        return pa.array((counter.count(t.as_py()) for t in texts), type=pa.int64())

    return counted(text)


def _windows(text: Column, chunk: int) -> Column:
    """(index, window, lead, last) of each chunk.

    Cut in two steps, as finding a place in a text takes time in proportion to it.
    """
    n, size = F.length(text), chunk * PART
    cut = lambda t, begin, end: F.substring(t, begin + 1, end - begin)
    last = F.floor((n - 1) / chunk).cast("int")

    def part(k: Column) -> Column:
        base = F.greatest(k * size - BACK, F.lit(0))
        own = F.array(F.struct(cut(text, base, (k + 1) * size + WINDOW).alias("t")))

        def window(i: Column, t: Column) -> Column:
            begin = F.greatest(i * chunk - BACK, F.lit(0))
            return F.struct(i.alias("index"), cut(t, begin - base, (i + 1) * chunk + WINDOW - base).alias("window"), (i * chunk - begin).alias("lead"), (i == last).alias("last"))

        return F.flatten(F.transform(own, lambda o: F.transform(F.sequence(k * PART, F.least((k + 1) * PART - 1, last)), lambda i: window(i, o["t"]))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), part))


MAP = T.ArrayType(T.StructType([T.StructField("enter", T.StringType()), T.StructField("leave", T.StringType()), T.StructField("n", T.LongType())]))


def chunk_maps(texts: DataFrame, spec: str, chunk: int = CHUNK) -> DataFrame:
    """(hash, index, map) of the chunks of texts (hash, text): chunks are dealt to all tasks."""

    @F.arrow_udf(MAP)
    def mapped(window: pa.Array, lead: pa.Array, last: pa.Array) -> pa.Array:
        counter, name = compiled(spec), lambda ends: ",".join(map(str, ends))
        rows = zip(window, lead, last, strict=True)
        maps = [counter.state_map(w.as_py(), a.as_py(), z.as_py(), chunk) for w, a, z in rows]
        return pa.array([[{"enter": name(a), "leave": name(b), "n": n} for a, (b, n) in m.items()] for m in maps], type=pa.list_(pa.struct([("enter", pa.string()), ("leave", pa.string()), ("n", pa.int64())])))

    rows = texts.select("hash", F.explode(_windows(F.col("text"), chunk)).alias("c")).select("hash", "c.*")
    rows = rows.repartition(F.col("hash"), F.col("index"))
    return rows.select("hash", "index", mapped("window", "lead", "last").alias("map"))


def compose(maps: DataFrame, most: int) -> DataFrame:
    """(hash, map) of whole texts from maps of at most `most` neighbouring chunks each; TOGETHER of them meet in a row each round."""

    def then(a: Column, b: Column) -> Column:
        step = lambda e, f: F.struct(e["enter"].alias("enter"), f["leave"].alias("leave"), (e["n"] + f["n"]).alias("n"))
        return F.flatten(F.transform(a, lambda e: F.transform(F.filter(b, lambda f: f["enter"] == e["leave"]), lambda f: step(e, f))))

    while most > 1:
        grouped = maps.groupBy("hash", F.floor(F.col("index") / TOGETHER).alias("above")).agg(F.array_sort(F.collect_list(F.struct("index", "map"))).alias("m"))
        every = F.transform("m", lambda x: x["map"])
        maps = grouped.select("hash", F.col("above").alias("index"), F.aggregate(F.slice(every, F.lit(2), F.size("m")), F.element_at(every, 1), then).alias("map"))
        most = -(-most // TOGETHER)
    return maps.select("hash", "map")


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", chunk: int = CHUNK, broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs, all columns, with _n_tokens: tokens of each whole text as a long.

    Texts of at most `chunk` bytes are counted where they are.  Longer ones are counted once for
    all copies, by the maps of their chunks; those whose maps do not meet are counted from their
    start.  0 for null and empty texts; rows that repeat stay; an empty table gives an empty
    result; an input column _n_tokens is replaced.  Texts are read twice and only those of long
    texts' chunks move.
    """
    if chunk < BACK:
        raise ValueError(f"chunks have at least {BACK} characters")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    docs, restored = set_aside(docs, ("_text_hash", "_n_short"), ("_n_tokens",), text_col)
    text, names = F.col(f"`{text_col}`"), [F.col(f"`{c}`") for c in docs.columns]
    is_long = F.coalesce(F.octet_length(text), F.lit(0)) > chunk
    long = docs.where(is_long).select(F.sha2(text, 256).alias("hash"), text.alias("text"))
    maps = materialize(chunk_maps(long, spec, chunk).dropDuplicates(["hash", "index"]), "chunk-maps")
    most = maps.agg(F.max("index")).first()[0]
    if most is None:
        return restored(docs.select(*names, token_counts(text, path).alias("_n_tokens")))
    whole = F.filter("map", lambda e: e["enter"] == START)
    counts = compose(maps, most + 1).select(F.col("hash").alias("_text_hash"), F.try_element_at(whole, F.lit(1))["n"].alias("_n_tokens"))
    counts = materialize(counts, "long-texts")
    lost = counts.where("_n_tokens is null").select(F.col("_text_hash").alias("hash"))
    if not lost.isEmpty():
        again = long.join(broadcast_if(lost, broadcast_rows), "hash", "left_semi")
        again = again.select(F.col("hash").alias("_text_hash"), token_counts(F.col("text"), path).alias("_n_tokens")).groupBy("_text_hash").agg(F.max("_n_tokens").alias("_n_tokens"))
        counts = materialize(counts.where("_n_tokens is not null").unionByName(again), "long-texts")
    # Short texts have keys that meet none, many of them, so that a shuffled join does not gather them.
    key = F.when(is_long, F.sha2(text, 256)).otherwise(F.hex(F.xxhash64(text)))
    rows = docs.select(*names, key.alias("_text_hash"), token_counts(F.when(~is_long, text), path).alias("_n_short"))
    rows = rows.join(broadcast_if(counts, broadcast_rows), "_text_hash", "left")
    return restored(rows.select(*names, F.coalesce("_n_tokens", "_n_short").alias("_n_tokens")))
