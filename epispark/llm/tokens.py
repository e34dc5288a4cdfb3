"""Token counts with overlap resynchronisation.

Short texts are encoded whole. A huge text is encoded in overlapping chunks, so that no encoding
holds more than one chunk. Two neighbouring chunks are spliced at a word boundary of the
pre-tokeniser that both found at the same place in their overlap. From such a place on both chunks go
on alike: the splitting pattern looks ahead only, never back. Places within a margin of
either end of the overlap are not used, since a cut there may hide what the pattern looks ahead for,
or part of an added token. If the overlap has no common place (one unbroken run), it is doubled and
the chunk encoded again, at last up to the end of the text.

Short texts of a byte-level tokenizer are counted by blocks: its pattern always begins a word at a
space before a character that is not white space, so the blocks between such spaces are encoded
independently, and a block seen before is looked up in a bounded table. A text with other runs of
white space is encoded whole.

Defined results: a null text counts as empty and has no tokens; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from epispark.llm.common import whole_text

CHUNK, OVERLAP = 32_768, 512
#: Code points, more than the longest look-ahead; a longer added token widens it (`_margin`).
MARGIN = 24
#: Code points that are encoded in one call at most.
CALL = 1 << 19
#: Characters of the blocks that a Python worker keeps, and of the longest of them.
KEPT_BLOCKS, LONG_BLOCK = 4_000_000, 100
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a .json file, once per Python worker, with untrimmed offsets."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        for part in ("pre_tokenizer", "post_processor"):
            if spec.get(part) and "trim_offsets" in spec[part]:
                spec[part]["trim_offsets"] = False  # offsets only; ids stay the same
        spec["truncation"] = spec["padding"] = None
        _loaded[path] = Tokenizer.from_str(json.dumps(spec))
        _loaded[path, "blocks"] = Blocks(_loaded[path]) if _cuts_at_spaces(spec) else None
    return _loaded[path]


def blocks_of(path: str) -> Blocks | None:
    """The table of blocks of a tokenizer, if its texts may be counted by blocks."""
    tokenizer(path)
    return _loaded[path, "blocks"]


def _cuts_at_spaces(spec: dict) -> bool:
    """Whether a space before other than white space always begins a word."""
    split = spec.get("pre_tokenizer") or {}
    return (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not spec.get("normalizer") and not spec["model"].get("dropout")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(map(str.isspace, t["content"])) for t in spec.get("added_tokens", [])))


class Blocks(dict):
    """Tokens of a space followed by the block; minus one where the block is empty or begins with white space."""

    def __init__(self, tok):
        self.tok, self.size = tok, 0

    def __missing__(self, block: str) -> int:
        n = -1 if not block or block[0].isspace() else len(self.tok.encode(" " + block, add_special_tokens=False))
        if len(block) <= LONG_BLOCK:
            if self.size >= KEPT_BLOCKS:
                self.clear()
                self.size = 0
            self[block] = n
            self.size += len(block)
        return n

    def count(self, text: str) -> int | None:
        """Tokens of a text, or None if it has white space that needs the whole text."""
        first, *rest = text.split(" ")
        found = list(map(self.__getitem__, rest))
        if not first or -1 in found:
            return None
        return len(self.tok.encode(first, add_special_tokens=False)) + sum(found)


def _margin(tok) -> int:
    """Code points at either end of a chunk that may hold a part of an added token or of a look-ahead."""
    return max([MARGIN, *(len(t.content) + 1 for t in tok.get_added_tokens_decoder().values())])


def _starts(encoding, base: int) -> dict[int, int]:
    """Place in the text of each word's start -> tokens of the chunk before it."""
    words, offsets = encoding.word_ids, encoding.offsets
    return {base + offsets[k][0]: k for k in range(len(words)) if not k or words[k] != words[k - 1]}


def count_spliced(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, from chunks that are spliced where both agree."""
    margin = _margin(tok)
    at, total, skip = 0, 0, 0  # start of the chunk; tokens before it; tokens of the chunk already counted
    encoding = tok.encode(text[:chunk], add_special_tokens=False)
    end = min(len(text), chunk)
    while end < len(text):
        mine, wider = _starts(encoding, at), overlap
        while True:
            begin = max(at, end - wider)
            stop = min(len(text), begin + max(chunk, 2 * wider))
            following = tok.encode(text[begin:stop], add_special_tokens=False)
            theirs = _starts(following, begin)
            low, high = begin + (margin if begin else 0), end - margin
            common = [p for p in mine if low <= p <= high and mine[p] >= skip and p in theirs]
            if common:
                place = max(common)
                total += mine[place] - skip
                at, skip, encoding, end = begin, theirs[place], following, stop
                break
            if begin == at:  # the whole chunk has no common place: let it grow
                end = min(len(text), at + 2 * (end - at))
                encoding = tok.encode(text[at:end], add_special_tokens=False)
                if end == len(text):
                    return total + len(encoding.ids) - skip
                mine, wider = _starts(encoding, at), overlap
            else:
                wider *= 2
    return total + len(encoding.ids) - skip


def counts(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, blocks: Blocks | None = None) -> list[int]:
    out, short, size = [0] * len(texts), [], 0

    def flush():
        for k, e in zip(short, tok.encode_batch_fast([texts[k] for k in short], add_special_tokens=False)):
            out[k] = len(e)
        short.clear()

    for k, text in enumerate(texts):
        if len(text) > chunk:
            out[k] = count_spliced(tok, text, chunk, overlap)
        elif blocks is not None and (n := blocks.count(text)) is not None:
            out[k] = n
        elif text:
            short.append(k)
            size += len(text)
            if size >= CALL:
                flush()
                size = 0
    flush()
    return out


def token_count(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """A vectorised function text -> tokens by the tokenizer file at `path`, which every executor has."""

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd

        return pd.Series(counts(tokenizer(path), texts.fillna("").tolist(), chunk, overlap, blocks_of(path)), dtype="int64")

    def of(text: Column) -> Column:
        return count(whole_text(text))

    return of
