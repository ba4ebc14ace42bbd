"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is encoded alone: those that come out as one token form the whole-token set
(`whole_tokens`). At run time a text is cut into pre-tokens by the tokenizer's own pattern; a pre-token of the set
counts as one token without any merging, and only the rest goes through the merges. Merges never cross pre-tokens,
so the sum equals the library's count.

Special strings are what the library's default makes of them: one token each, and the text around them is cut
apart there. Null and empty texts have no tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from regionlens.llm.common import ship, slices

#: Chunks in a generation of what a worker remembers: memory and time depend on it, results don't.
REMEMBERED = 500_000
_LOADED: dict[str, Counter] = {}


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies print for each byte: printable bytes as they are, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)})
    return letters


def whole_tokens(tokenizer: Tokenizer) -> set[str]:
    """Vocabulary strings that are one pre-token and that the merges alone turn into their own single token."""
    letters, pattern = byte_letters(), regex.compile(public_tokenizers.PATTERN)
    strings, ids = [], []
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        try:
            text = bytes(letters[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):  # part of a character: no text is this token alone
            continue
        if pattern.fullmatch(text) and pattern.findall(text) == [text]:
            strings.append(text)
            ids.append(i)
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return {s for s, i, e in zip(strings, ids, encoded) if e.ids == [i]}


def ranks_of(tokenizer: Tokenizer) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, if its ids follow the order of its merges; else None."""
    model, letters = json.loads(tokenizer.to_str())["model"], byte_letters()
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(set(made)) or len(made) + 256 != len(model["vocab"]) or min(made, default=256) < 256:
        return None
    return {bytes(letters[c] for c in token): i for token, i in model["vocab"].items()}


class Counter:
    """Counts the tokens of whole texts with one vocabulary file."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.whole = whole_tokens(self.tokenizer)
        self.cut = regex.compile(public_tokenizers.PATTERN).findall
        ranks = ranks_of(self.tokenizer)
        if ranks is None:
            self.merge = lambda piece: len(self.tokenizer.encode(piece, add_special_tokens=False))
        else:
            core = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.merge = lambda piece: len(core.encode_single_piece(piece.encode()))
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        """Pre-tokens of the whole-token set count as one; the others are merged."""
        whole, merge = self.whole, self.merge
        return sum([1 if piece in whole else merge(piece) for piece in self.cut(text)])

    def plain(self, text: str) -> int:
        """The count of a text without special strings.

        A space between two characters that are no white space always begins a pre-token, so such texts are counted
        chunk by chunk, and a chunk seen before is looked up.
        """
        first, *chunks = text.split(" ")
        total, known = self.pieces(first), self.known
        for chunk in chunks:
            n = known.get(chunk)
            if n is None:
                n = self.lookup(chunk)
            if n < 0:
                return self.pieces(text)
            total += n
        return self.pieces(text) if first[-1:].isspace() else total

    def lookup(self, chunk: str) -> int:
        """The count of a chunk with its space, -1 beside other white space. Two generations are remembered."""
        n = self.older.get(chunk)
        if n is None:
            n = self.pieces(" " + chunk) if chunk and not chunk[0].isspace() and not chunk[-1].isspace() else -1
        if len(chunk) < 100:
            if len(self.known) >= REMEMBERED:
                self.older = dict(self.known)
                self.known.clear()
            self.known[chunk] = n
        return n

    def count(self, text: str) -> int:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.plain, parts))


def count_tokens(texts: list[str], path: str) -> list[int]:
    """The number of tokens of each text."""
    if path not in _LOADED:
        _LOADED[path] = Counter(path)
    return list(map(_LOADED[path].count, texts))


def add_token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of `docs`, repeated rows included, over its whole text.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null. Other columns of `docs` are not read.
    `path`: the vocabulary file, on every executor.
    """
    ship(docs.sparkSession)
    file = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = pc.fill_null(batch.column("text"), "")
            n = pa.array(count_tokens(texts.to_pylist(), file), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pc.binary_length(texts).cast("int64"), n], ["doc_id", "n_bytes", "n_tokens"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
