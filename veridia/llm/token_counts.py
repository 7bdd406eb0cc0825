"""Token counts (operator 8): exact prefix tables by dynamic programming.

The tokenizer's pre-tokenizer never joins characters across white space, so the encoding of a text
is the concatenation of the encodings of its chunks between ASCII white space, and a chunk's that of
its words (pre-tokens).  One pass of dynamic programming stores for each word the count at every one of
its prefixes (`Merges`); a step advances all new words of a batch by one character, in numpy.  The
count at a prefix of a text is that before the last chunk, plus that before the last word in it, plus
an entry of a word's table; nothing is encoded.  Tables are remembered over all texts of a worker.
Truncation and budget questions are look-ups, and the query's counts are the tables' last entries.

`ChunkCounter` takes only tokenizers whose splitting it has checked to be of this kind; those of other
kinds are counted over whole texts by their library (`WholeCounter`) and have no prefix tables.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows are counted row by
row; white space only has 0 tokens; rows with a null id keep it; tokens are looked up by 64-bit hashes
of up to LANE characters.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, mix64, slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Chunks, and words, whose counts a worker remembers; the memory is emptied when there are more.
REMEMBERED = 1_000_000
#: Words of up to so many characters are advanced together; longer ones one by one.
LANE = 32
PORTION = 1 << 16
#: Bytes of chunks that are remembered at most.
HELD = 1 << 27
#: Bytes of text that are worked on at once.
TOGETHER = 8 << 20
#: What a tokenizer must split by, so that no token crosses white space and words can be cut as `_ASCII` does (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ASCII = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9\n]+")

_counters: dict[str, ChunkCounter | WholeCounter] = {}


def vocabulary_path(name_or_path: str = VOCABULARY) -> str:
    if os.path.sep in name_or_path:
        return name_or_path
    import public_tokenizers

    return str(public_tokenizers.path(name_or_path))


class Merges:
    """BPE as a table: for each prefix of a pre-token (a string with a character for each byte) the number
    of its tokens, by dynamic programming. The last token of a prefix is the only one that ends there and
    that no merge tears from the last token before it, so a prefix costs a step, not an encoding."""

    def __init__(self, model: dict):
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {m: i for i, m in enumerate(pairs)}
        self.made = {x + y: i for i, (x, y) in enumerate(pairs)}
        self.pairs, self.vocab = pairs, model["vocab"]
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def _apart(self, a: str, b: str, limit: float = float("inf")) -> bool:
        """Whether no merge across the border of a and b comes before those that make a and b: these are undone, latest first."""
        made, rank, pairs = self.made, self.rank, self.pairs
        while True:
            if rank.get((a, b), limit) < limit:
                return False
            x, y = made.get(a, -1), made.get(b, -1)
            if x > y:
                limit, a = x, pairs[x][1]
            elif y >= 0:
                limit, b = y + 1, pairs[y][0]
            else:
                return True

    def _token(self, t: str) -> bool:
        """Whether t is a token that its own bytes are encoded as."""
        if t not in self.whole:
            i = self.made.get(t)
            self.whole[t] = t in self.vocab if i is None else self._apart(*self.pairs[i], i) and all(map(self._token, self.pairs[i]))
        return self.whole[t]

    def prefixes(self, word: str) -> list[int]:
        """Tokens of word[:0], word[:1], ..., each as a word that ends there."""
        last, opened, out, end, fits, vocab = [""], [0], [0], self.end, self.fits, self.vocab

        def find(i: int, end: str) -> tuple[str, int]:
            for n in range(min(i, self.longest), 0, -1):
                t = word[i - n : i] + end
                if t in vocab and self._token(t):
                    if n == i:
                        return t, 1
                    pair = last[i - n], t
                    ok = fits.get(pair)
                    if ok is None:
                        ok = fits[pair] = self._apart(*pair)
                    if ok:
                        return t, opened[i - n] + 1
            raise ValueError(f"no token ends at {i} of {word!r}")

        for i in range(1, len(word) + 1):
            out.append(find(i, end)[1])
            t, n = find(i, "")
            last.append(t)
            opened.append(n)
        if len(fits) > 2_000_000:
            fits.clear()
        return out

    def prepare(self) -> None:
        """Tables for `lanes`: the slot of a hash to a token, without and with the end of a word; pairs that are known to fit or not."""
        self.names = [t for t in self.vocab if len(t.removesuffix(self.end)) <= LANE and self._token(t)]
        own = [(i, t) for i, t in enumerate(self.names) if not (self.end and t.endswith(self.end))]
        ends = [(i, t.removesuffix(self.end)) for i, t in enumerate(self.names) if self.end and t.endswith(self.end)] if self.end else own
        self.inner, self.final = _Slots(own), _Slots(ends)
        self.pair_key = np.full(1 << 20, -1, dtype=np.int64)
        self.pair_fits = np.zeros(1 << 20, dtype=bool)

    def _fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which tokens b can follow tokens a: remembered in a table where later pairs displace earlier ones."""
        key = a.astype(np.int64) * len(self.names) + b
        slot = (mix64(key.view(np.uint64)) & np.uint64(len(self.pair_key) - 1)).astype(np.int64)
        new = self.pair_key[slot] != key
        out = self.pair_fits[slot]
        if new.any():
            todo, which = np.unique(key[new], return_inverse=True)
            fits = np.fromiter((self._apart(self.names[k // len(self.names)], self.names[k % len(self.names)]) for k in todo.tolist()), dtype=bool, count=len(todo))
            out[new] = fits[which]
            at = (mix64(todo.view(np.uint64)) & np.uint64(len(self.pair_key) - 1)).astype(np.int64)
            at, first = np.unique(at, return_index=True)  # a slot keeps one pair with its own answer
            self.pair_key[at], self.pair_fits[at] = todo[first], fits[first]
        return out

    def lanes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The tables of many words of up to LANE characters, one after the other, and where each begins."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        order = np.argsort(-size, kind="stable")
        length, out = size[order], np.zeros(begin[-1], dtype=np.uint8)
        codes = np.frombuffer("".join(words).encode("utf-16-le"), dtype=np.uint16)
        first = (np.cumsum(size) - size)[order]
        top = int(length[0]) if len(length) else 0
        total = np.zeros((top + 1, len(words)), dtype=np.uint64)
        for i in range(top):
            k = np.searchsorted(-length, -i, side="left")  # words of more than i characters
            total[i + 1, :k] = total[i, :k] + _LETTER[codes[first[:k] + i]] * _UP[i]
        last, opened = np.full((top + 1, len(words)), -1, dtype=np.int32), np.zeros((top + 1, len(words)), dtype=np.uint8)
        for i in range(1, top + 1):
            k = int(np.searchsorted(-length, -i, side="right"))
            for slots, inner in ((self.inner, True), (self.final, False)):
                rows = np.arange(k)
                for n in range(min(i, slots.longest), 0, -1):
                    token = slots.find((total[i, rows] - total[i - n, rows]) * _DOWN[i - n], n)
                    hit = np.flatnonzero(token >= 0)
                    if len(hit) and n < i:
                        hit = hit[self._fit(last[i - n, rows[hit]], token[hit])]
                    if len(hit):
                        at = rows[hit]
                        n_tokens = opened[i - n, at] + 1
                        if inner:
                            last[i, at], opened[i, at] = token[hit], n_tokens
                        else:
                            out[begin[order[at]] + i] = n_tokens
                        rows = np.delete(rows, hit)
                        if not len(rows):
                            break
                if len(rows):
                    raise ValueError(f"no token ends at {i} of {words[order[rows[0]]]!r}")
        return out, begin[:-1]


_LETTER = mix64(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93
_UP = np.array([pow(_STEP, i, 1 << 64) for i in range(LANE + 1)], dtype=np.uint64)
_DOWN = np.array([pow(_STEP, -i, 1 << 64) for i in range(LANE + 1)], dtype=np.uint64)


class _Slots:
    """Tokens by the hash of their characters."""

    def __init__(self, tokens: list[tuple[int, str]]):
        self.longest = max((len(t) for _, t in tokens), default=0)
        self.lengths = {len(t) for _, t in tokens}
        hashes = np.array([sum(int(_LETTER[ord(ch)]) * int(_UP[i]) for i, ch in enumerate(t)) & (1 << 64) - 1 for _, t in tokens], dtype=np.uint64)
        ids, bits = np.array([i for i, _ in tokens], dtype=np.int32), 20
        while True:  # a table in which no two tokens want the same slot needs no probing: two choices of slot, the second for what is left
            self.mask = np.uint64((1 << bits) - 1)
            self.hash, self.token = [], []
            left, left_ids = hashes, ids
            for turn in range(3):
                slot = self._slot(left, turn)
                first = np.unique(slot, return_index=True)[1]
                h, t = np.zeros(1 << bits, dtype=np.uint64), np.full(1 << bits, -1, dtype=np.int32)
                h[slot[first]], t[slot[first]] = left[first], left_ids[first]
                self.hash.append(h)
                self.token.append(t)
                rest = np.ones(len(left), bool)
                rest[first] = False
                left, left_ids = left[rest], left_ids[rest]
                if not len(left):
                    return
            if len(np.unique(hashes)) < len(hashes):
                raise ValueError("two tokens have the same hash")
            bits += 1

    def _slot(self, h: np.ndarray, turn: int) -> np.ndarray:
        return (mix64(h + np.uint64(turn)) & self.mask).astype(np.int64)

    def find(self, h: np.ndarray, n: int) -> np.ndarray:
        """The token of each hash of n characters, or -1."""
        if n not in self.lengths:
            return np.full(len(h), -1, dtype=np.int32)
        out = np.full(len(h), -1, dtype=np.int32)
        for turn, (known, token) in enumerate(zip(self.hash, self.token)):
            slot = self._slot(h, turn)
            out = np.where((known[slot] == h) & (token[slot] >= 0), token[slot], out)
        return out


def _joins(ch: str) -> bool:
    """Whether ch can be composed with or ordered among the characters before it."""
    return unicodedata.category(ch)[0] == "M" or "\u1160" <= ch <= "\u11ff" or "\U00016d63" <= ch <= "\U00016d6a"


def _load(vocabulary: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _parts(told: dict | None, key: str) -> list[dict]:
    return [] if told is None else told[key] if told["type"] == "Sequence" else [told]


def cuts_at_spaces(told: dict) -> bool:
    """Whether a tokenizer's description is of the kind that ChunkCounter counts exactly."""
    model, before = told["model"], _parts(told["normalizer"], "normalizers")
    cut = _parts(told["pre_tokenizer"], "pretokenizers")
    return (
        model["type"] == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and [x["type"] for x in before] == ["NFC", "Replace", "Lowercase"]
        and (before[1]["pattern"], before[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and [x["type"] for x in cut] == ["Split", "ByteLevel"]
        and (cut[0]["pattern"], cut[0]["behavior"], cut[0]["invert"]) == ({"Regex": SPLIT}, "Removed", True)
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in told["added_tokens"])
    )


def counter_of(vocabulary: str = VOCABULARY) -> ChunkCounter | WholeCounter:
    """The counter of a vocabulary that this worker has, or a new one."""
    if vocabulary not in _counters:
        if vocabulary.endswith(".json"):
            tokenizer = _load(vocabulary)
            fits = cuts_at_spaces(json.loads(tokenizer.to_str()))
            _counters[vocabulary] = ChunkCounter(vocabulary) if fits else WholeCounter(vocabulary)
        else:
            _counters[vocabulary] = WholeCounter(vocabulary)
    return _counters[vocabulary]


class WholeCounter:
    """Counts by the vocabulary's own library, each text from its first to its last character."""

    def __init__(self, vocabulary: str):
        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
            self.count = lambda text: len(model.encode(text, add_bos=False, add_eos=False))
        else:
            tokenizer = _load(vocabulary)
            self.count = lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)

    def totals(self, texts: list[bytes | None]) -> list[int]:
        return [self.count(x.decode("utf-8", "replace")) if x else 0 for x in texts]

    def within(self, texts: list[bytes | None], n: list[int], limit: int) -> list[int | None]:
        """No prefix tables, so no lengths of prefixes but those of texts that fit."""
        return [len((x or b"").decode("utf-8", "replace")) if k <= limit else None for x, k in zip(texts, n)]


class ChunkCounter:
    """Exact token counts of all prefixes of words and of chunks without white space, remembered."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.tokenizer = _load(vocabulary)
        told = json.loads(self.tokenizer.to_str())
        if not cuts_at_spaces(told):
            raise ValueError(f"{vocabulary} doesn't cut texts at white space as prefix tables need it")
        self.merges = Merges(told["model"])
        self.merges.prepare()
        specials = [x["content"] for x in told["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.special_bytes, self.head = re.compile(self.special.pattern.encode()), os.path.commonprefix(specials).encode()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # tokens of a chunk
        self.words: dict[str, int] = {}  # where the table of a word begins
        self.ends: dict[str, int] = {}  # the table's last entry
        self.tables = np.zeros(0, dtype=np.uint8)
        self.held = 0
        self.chunk_tables: dict[bytes, np.ndarray] = {}

    @classmethod
    def shared(cls, vocabulary: str) -> ChunkCounter:
        found = counter_of(vocabulary)
        if not isinstance(found, cls):
            raise ValueError(f"{vocabulary} has no prefix tables")
        return found

    def learn_words(self, words: set[str]) -> None:
        """Makes the tables of words of up to LANE characters that aren't there yet."""
        new = sorted((w for w in words if len(w) <= LANE and w not in self.words), key=len)
        for k in range(0, len(new), PORTION):
            made, begin = self.merges.lanes(new[k : k + PORTION])
            self.words.update(zip(new[k : k + PORTION], (begin + len(self.tables)).tolist()))
            self.ends.update(zip(new[k : k + PORTION], made[np.append(begin[1:], len(made)) - 1].tolist()))
            self.tables = np.concatenate([self.tables, made])

    def _word(self, word: str) -> np.ndarray | list[int]:
        if len(word) > LANE:
            return self.merges.prefixes(word)
        if word not in self.words:
            self.learn_words({word})
        at = self.words[word]
        return self.tables[at : at + len(word) + 1].tolist()

    def _cut(self, chunks: list[bytes]) -> list[list[str]]:
        """The words of chunks, by one pass over all ASCII ones and one over all others."""
        out: list[list[str]] = [[] for _ in chunks]
        texts = [x.decode("utf-8", "replace") for x in chunks]
        plain = [i for i, x in enumerate(texts) if x.isascii() and x.isprintable()]
        k, own = 0, []
        for word in _ASCII.findall("\n".join([texts[i].lower() for i in plain])):
            if word == "\n":
                out[plain[k]] = own
                k, own = k + 1, []
            else:
                own.append(word)
        if plain:
            out[plain[k]] = own
        normalize, others = self.tokenizer.normalizer.normalize_str, [i for i, x in enumerate(texts) if not (x.isascii() and x.isprintable())]
        for a, b in slices([chunks[i] for i in others], 1 << 16):
            normal = [normalize(texts[i]) for i in others[a:b]]
            ends = list(accumulate(len(x) + 1 for x in normal))
            k = 0
            for word, (start, _) in self._pieces(" ".join(normal)):
                while start >= ends[k]:
                    k += 1
                out[others[a + k]].append(word)
        return out

    def _pieces(self, normal: str) -> list[tuple[str, tuple[int, int]]]:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)

    def _plain(self, text: str) -> list[int]:
        """Tokens of text[:0], text[:1], ... without added tokens."""
        normalize = self.tokenizer.normalizer.normalize_str
        ends, odd = None, []
        if text.isascii() and text.isprintable():
            normal = text.lower()
        else:
            normal, ends, at = "", [0], 0
            while at < len(text):
                to = at + 1
                while to < len(text) and _joins(text[to]):
                    to += 1
                odd += [(j, len(normal), normalize(text[at:j])) for j in range(at + 1, to)]
                normal += normalize(text[at:to])
                ends += [len(normal)] * (to - at)
                at = to
        counts, total, starts, before = [0], 0, [], []
        for word, (a, b) in self._pieces(normal):
            counts += [total] * (a + 1 - len(counts))
            starts.append(a)
            before.append(total)
            table = self._word(word)
            if len(word) == b - a:
                counts += [total + n for n in table[1:]]
            else:
                counts += [total + table[n] for n in accumulate(len(ch.encode()) for ch in normal[a:b])]
            if b - a == 3 and word in ("'re", "'ve", "'ll"):  # only whole contractions are words
                counts[a + 2] = total + self._word("'")[-1] + self._word(word[1])[-1]
            total += table[-1]
        counts += [total] * (len(normal) + 1 - len(counts))
        if ends is None:
            return counts
        out = [counts[e] for e in ends]
        for j, at, tail in odd:  # a prefix that ends inside a composed character: its last two words are cut anew
            k = max(0, bisect_right(starts, at - 1) - 2)
            start, have = (starts[k], before[k]) if starts and starts[k] < at else (at, counts[at])
            out[j] = have + sum(self._word(w)[-1] for w, _ in self._pieces(normal[start:at] + tail))
        return out

    def prefixes(self, chunk: str) -> np.ndarray:
        """Tokens of chunk[:0], chunk[:1], ..."""
        out, at = [0], 0
        for m in self.special.finditer(chunk):
            base = out.pop()
            part = self._plain(chunk[at : m.end() - 1])
            out += [base + n for n in part]
            out.append(base + part[m.start() - at] + 1)
            at = m.end()
        base = out.pop()
        return np.array(out + [base + n for n in self._plain(chunk[at:])], dtype=np.int32)

    def learn(self, chunks: set[bytes]) -> None:
        """Totals of chunks that aren't known yet, from the last entries of their words' tables."""
        new = chunks.difference(self.known)
        size = sum(map(len, new))
        if len(self.known) + len(new) > REMEMBERED or len(self.words) > REMEMBERED or self.held + size > HELD:
            self.forget()
            new = chunks
        if not new:
            return
        self.held += size
        odd = [x for x in new if self.head in x and self.special_bytes.search(x)]
        plain = list(new.difference(odd))
        cut = self._cut(plain)
        words = set().union(*cut)
        self.learn_words(words)
        self.ends.update((w, self.merges.prefixes(w)[-1]) for w in words if len(w) > LANE and w not in self.ends)
        self.known.update(zip(plain, [sum(map(self.ends.__getitem__, own)) for own in cut]))
        self.known.update((x, int(self.table(x)[-1])) for x in odd)

    def table(self, chunk: bytes) -> np.ndarray:
        """The counts at every prefix of a chunk."""
        if len(chunk) > 64:
            return self.prefixes(chunk.decode("utf-8", "replace"))
        if chunk not in self.chunk_tables:
            if len(self.chunk_tables) >= REMEMBERED // 10:
                self.chunk_tables.clear()
            self.chunk_tables[chunk] = self.prefixes(chunk.decode("utf-8", "replace"))
        return self.chunk_tables[chunk]

    def totals(self, texts: list[bytes | None]) -> list[int]:
        """The last entry of each text's prefix table."""
        split = [(x or b"").split() for x in texts]
        self.learn(set().union(*split))
        return [sum(map(self.known.__getitem__, words)) for words in split]

    def within(self, texts: list[bytes | None], n: list[int], limit: int) -> list[int | None]:
        """For each text the length of its longest prefix of at most `limit` tokens; n: its tokens."""
        return [len((x or b"").decode("utf-8", "replace")) if k <= limit else self._within(x, limit) for x, k in zip(texts, n)]

    def _within(self, raw: bytes, limit: int) -> int:
        """PrefixTable.truncate, of which only the entries up to the limit are made."""
        left = limit
        for k, chunk in enumerate(raw.split()):
            n = self.known[chunk]
            if n > left:
                break
            left -= n
        before = raw[: len(raw) - len(raw.split(None, k)[k])]  # all up to the chunk that doesn't fit
        fit = np.flatnonzero(self.table(chunk)[1:] <= left)
        if len(fit):
            return len(before.decode("utf-8", "replace")) + int(fit[-1]) + 1
        return len(before.rstrip().decode("utf-8", "replace"))


class PrefixTable:
    """The exact token count of every prefix of one text: that before each chunk and, inside, its chunk's table."""

    def __init__(self, text: str, counter: ChunkCounter):
        self.text, self.counter = text, counter
        split = text.encode().split()
        counter.learn(set(split))
        self.starts = [m.start() for m in re.finditer(r"[^\t-\r ]+", text)]
        self.chunks = split
        self.sizes = [len(m.decode()) for m in split]
        self.before = [0, *accumulate(map(counter.known.__getitem__, split))]

    def count(self, end: int | None = None) -> int:
        """Tokens of text[:end]."""
        end = len(self.text) if end is None else end
        k = bisect_right(self.starts, end - 1) - 1
        if k < 0:
            return 0
        inside = end - self.starts[k]
        return self.before[k + 1] if inside >= self.sizes[k] else self.before[k] + int(self.counter.table(self.chunks[k])[inside])

    def counts(self) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..."""
        out = np.zeros(len(self.text) + 1, dtype=np.int32)
        for k, (start, chunk) in enumerate(zip(self.starts, self.chunks)):
            table = self.counter.table(chunk)
            out[start : start + len(table)] = self.before[k] + table
            out[start + len(table) :][: (self.starts[k + 1] if k + 1 < len(self.starts) else len(out)) - start - len(table)] = self.before[k + 1]
        return out

    def truncate(self, budget: int) -> int:
        """The length of the longest prefix of at most `budget` tokens that ends with a chunk or
        inside the first chunk that doesn't fit."""
        k = bisect_right(self.before, budget) - 1
        if k >= len(self.chunks):
            return len(self.text)
        fit = np.flatnonzero(self.counter.table(self.chunks[k])[1:] <= budget - self.before[k])
        if len(fit):
            return self.starts[k] + int(fit[-1]) + 1
        return self.starts[k - 1] + self.sizes[k - 1] if k else 0

    def windows(self, budget: int) -> list[tuple[int, int]]:
        """Runs of whole chunks of at most `budget` tokens each; a larger chunk stands alone."""
        out, k = [], 0
        while k < len(self.chunks):
            j = max(k + 1, bisect_right(self.before, self.before[k] + budget) - 1)
            out.append((self.starts[k], self.starts[j - 1] + self.sizes[j - 1]))
            k = j
        return out


def token_counts(docs: DataFrame, limit: int = LIMIT, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit, limit_chars (code points of the longest prefix that the limit
    allows, from the prefix table; null if the vocabulary has none and the text doesn't fit) for each row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def count(batches):
        counter = counter_of(vocabulary)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            n, fit = [], []
            for a, b in slices(texts, TOGETHER):
                n += counter.totals(texts[a:b])
                fit += counter.within(texts[a:b], n[a:b], limit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    schema = f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint"
    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(lean(count), schema).withColumnRenamed("id", id_col)


def prefix_tables(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and counts (tokens of each prefix by its code points, from 0 on): the stored table
    that answers budget questions later without an encoding."""
    kind = docs.schema[id_col].dataType.simpleString()

    def build(batches):
        counter = ChunkCounter.shared(vocabulary)
        for batch in batches:
            counts = [PrefixTable(x or "", counter).counts() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.list_(pa.int32()))], names=["id", "counts"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(lean(build), f"id {kind}, counts array<int>").withColumnRenamed("id", id_col)
