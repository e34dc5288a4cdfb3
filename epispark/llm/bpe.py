"""BPE encoding and decoding with an index of pair occurrences.

The words of a block of texts that are not known yet are laid end to end as one chain of symbols. An
index maps each pair that may merge to all its places in that chain, and the ranks of the pairs that occur
are active. The lowest active rank is applied to all its places at once, in arrays; the pairs that the
merged symbols make with their neighbours are entered in the index. A place whose pair has gone
meanwhile is passed over, and of places that overlap (`aaa`) every other one from the left is merged. A
pair that a merge makes has a higher rank, as its token has no other merge (a file where one has is refused),
so every word gets its merges in the order of the ordinary algorithm. No pair reaches across the end of a word.

Tokenizer files are those of the `tokenizers` library with a BPE model over byte-level words, an end of
word suffix or none, and no decoder: decoding joins the tokens by one space. Other parts raise an
error, since the result would differ. Texts are normalised and split into words as the file says; added
tokens inside a text are found as the library does.

Ids are given as one binary value a text, each id as an unsigned 32-bit integer, lowest byte first.

Defined results: a null or empty text has no ids and decodes to the empty string; repeated rows and ties
get equal results; an empty table gives an empty result; other columns are not looked at. Words of any
length are merged whole. What a worker remembers is bounded by `KEPT` and `LONG`, what it holds of a block
by `NEW` and `BLOCK` and the batch.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from heapq import heappop, heappush

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.llm.common import whole_text

#: Characters of words that a worker remembers in a generation, of which it keeps two.
KEPT = 1_200_000
#: Longer words are forgotten with their generation.
LONG = 200
#: Characters of new words that are laid end to end, unless one word has more; words of the texts that are held meanwhile.
NEW, BLOCK = 1_000_000, 3_000_000
#: Below this code point letters, digits and small letters are the same in every release of Unicode in use, and no text changes
#: in normal form C. Controls, and a capital whose small letter is two characters, are left to the library.
SETTLED = "\u0180"
UNSETTLED = re.compile("[^\\t\\n\\v\\f\\r -~\u00a0-\u012f\u0131-\u017f]").search
_loaded: dict = {}


class Merges:
    """The merges of a model in the order of their ranks: pairs of ids and what they become."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        import numpy as np

        if len({whole for _, _, whole in pairs}) < len(pairs):
            raise ValueError("two merges make one token; the order of ranks would not hold")
        self.pairs = pairs
        keys = np.array([left << 17 | right for left, right, _ in pairs], dtype=np.int64)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]

    def _known(self, left, right):
        """Which pairs have a rank, and the ranks of those."""
        import numpy as np

        keys = left.astype(np.int64) << 17 | right  # negative beside the end of a word
        near = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[near] == keys
        return found, self.ranks[near[found]]

    def apply(self, chain):
        """Merge the symbols of words, each ended by -1, in place; what a merge swallows becomes -2."""
        import numpy as np

        n = len(chain)
        symbols = np.append(chain, np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        found, ranks = self._known(symbols[:-1], symbols[1:])
        at = np.flatnonzero(found)
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        firsts = np.flatnonzero(np.diff(ranks, prepend=-1))
        places = {int(ranks[k]): some.tolist() for k, some in zip(firsts, np.split(at, firsts[1:]))} if len(at) else {}
        active = list(places)  # in order, so a heap
        while active:
            rank = heappop(active)
            left, right, whole = self.pairs[rank]
            at = np.array(places.pop(rank), dtype=np.int32)
            at = at[(symbols[at] == left) & (symbols[after[at]] == right)]
            if left == right and len(at) > 1:  # of places that overlap, every other one from the left
                at = np.unique(at)
                begins = np.append(True, after[at[:-1]] != at[1:])
                nth = np.arange(len(at))
                at = at[(nth - np.maximum.accumulate(np.where(begins, nth, 0))) % 2 == 0]
            if not len(at):
                continue
            gone, behind = after[at], before[at]
            ahead = after[gone]
            symbols[at], symbols[gone] = whole, -2
            after[at], before[ahead] = ahead, at
            for place, one, other in ((behind, symbols[behind], symbols[at]), (at, symbols[at], symbols[ahead])):
                found, made = self._known(one, other)
                for new, where in zip(made.tolist(), place[found].tolist()):
                    if new in places:
                        places[new].append(where)
                    else:
                        places[new] = [where]
                        heappush(active, new)
        chain[:] = symbols[:-1]


class Numbers(dict):
    """A number for each word of the texts at hand, and the ids of each; `new` are the numbers and words without ids.

    Words of the generation before are still known; what was not used since then is forgotten."""

    def __init__(self):
        self.ids, self.old, self.new, self.size, self.length = [], {}, [], 0, 0

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.ids)
        ids = self.old.get(word)
        self.ids.append(ids)
        if ids is None:
            self.new.append((n, word))
            self.length += len(word)
        self.size += len(word)
        return n

    def turn(self) -> None:
        """Begin a generation."""
        self.old = {w: self.ids[n] for w, n in self.items() if len(w) <= LONG}
        self.clear()
        self.ids, self.size = [], 0


class Bpe:
    """The tokenizer of a file, with the words that this worker remembers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        split = steps[0] if steps else {}
        known = (model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback") and not model.get("ignore_merges")
                 and not model.get("continuing_subword_prefix") and not spec.get("decoder") and [s["type"] for s in steps] == ["Split", "ByteLevel"]
                 and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
                 and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and _small_letters(spec.get("normalizer") or {})
                 and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])))
        if not known:
            raise ValueError(f"{path}: a part of this tokenizer is not handled")
        spec["truncation"] = spec["padding"] = None
        library = Tokenizer.from_str(json.dumps(spec))
        self.normal, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.settled = _settled(split["pattern"]["Regex"])
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges([(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = {k: t for t, k in self.vocab.items()} | {k: t for t, k in self.added.items()}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = _byte_letters()
        self.inner, self.last = (np.array([self.vocab[c + end] for c in letters], dtype=np.int32) for end in ("", self.end))
        self.numbers = Numbers()

    def words(self, text: str) -> list[str]:
        """The words of a text as they are split; added tokens after a null character, which no word of theirs begins with."""
        out = []
        for piece in self.special.split(text) if self.special else [text]:
            if piece in self.added:
                out.append("\0" + piece)
            elif piece and not UNSETTLED(piece):
                out += self.settled(piece.lower())
            elif piece:  # letters of other scripts: as the library's own tables have them
                plain = self.normal(piece)
                out += [plain[a:b] for _, (a, b) in self.pieces(plain)]
        return out

    def learn(self) -> None:
        """The ids of the new words, through the index of their pairs."""
        import numpy as np

        numbers = self.numbers
        for n, word in numbers.new:
            if word[0] == "\0" and word[1:] in self.added:
                numbers.ids[n] = self.added[word[1:]].to_bytes(4, "little")
        new = [(n, word) for n, word in numbers.new if numbers.ids[n] is None]
        numbers.new, numbers.length = [], 0
        if not new:
            return
        letters = np.frombuffer(b"\xff".join([word.encode() for _, word in new] + [b""]), dtype=np.uint8)  # no byte of UTF-8 is 255
        ends = np.flatnonzero(letters == 255)
        chain = self.inner[letters]
        chain[ends - 1] = self.last[letters[ends - 1]]
        chain[ends] = -1
        self.merges.apply(chain)
        left = chain >= 0
        cuts = (4 * np.cumsum(left)[ends]).tolist()
        ids = chain[left].astype("<u4").tobytes()
        begin = 0
        for (n, _), cut in zip(new, cuts):
            numbers.ids[n] = ids[begin:cut]
            begin = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        out, block, size, numbers = [], [], 0, self.numbers

        def flush() -> None:
            nonlocal size
            self.learn()
            out.extend(b"".join(map(numbers.ids.__getitem__, words)) for words in block)
            block.clear()
            size = 0
            if numbers.size > KEPT:
                numbers.turn()

        for text in texts:
            words = array("I", map(numbers.__getitem__, self.words(text)))
            block.append(words)
            size += len(words)
            if numbers.length >= NEW or size >= BLOCK:
                flush()
        flush()
        return out

    def decode(self, ids: bytes) -> str:
        import numpy as np

        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _settled(pattern: str):
    """The words of a text of settled characters; their letters and digits are written out in the pattern."""
    def those(kind: str) -> str:
        return "".join(re.escape(c) for c in map(chr, range(ord(SETTLED))) if unicodedata.category(c)[0] == kind)

    return re.compile(pattern.replace(r"\p{L}", those("L")).replace(r"\p{N}", those("N"))).findall


def _small_letters(normalizer: dict) -> bool:
    """Whether texts are put into normal form C, white space into one space and letters into small ones."""
    steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normalizer.get("normalizers", [])]
    return steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is one, else the next from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def bpe(path: str) -> Bpe:
    """The tokenizer of a file, once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(path: str):
    """A vectorised function text -> ids by the tokenizer file at `path`, which every executor has."""

    @F.pandas_udf("binary")
    def ids(texts):
        import pandas as pd

        return pd.Series(bpe(path).encode(texts.fillna("").tolist()), dtype="object")

    def of(text: Column) -> Column:
        return ids(whole_text(text))

    return of


def decode(path: str):
    """A vectorised function ids -> text, the inverse of `encode` but for case, spaces and normal forms."""

    @F.pandas_udf("string")
    def texts(ids):
        import pandas as pd

        return pd.Series([bpe(path).decode(x or b"") for x in ids], dtype="object")

    return texts
