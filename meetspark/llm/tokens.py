"""Token ids and token counts by public tokenizers, in Arrow functions.

Texts are cut at safe boundaries and each distinct piece of a batch is encoded once by the tokenizer's own library. A
byte-level tokenizer splits a text before it merges; none of its splits keeps a character that is no white space together
with a space after it. So a text may be cut before each space that follows such a character, and the ids of the pieces, put
together, are the ids of the text. Special strings hold no white space and are never cut. Pieces of plain letters, digits and marks are
cut further where the kind of character changes, as the tokenizer's own pattern does, and the library's merges run once on each distinct part;
all other pieces go through the library whole. Other tokenizers get whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetspark.llm.common import balanced, bound_batches, release_memory, texts_of

#: The vocabulary file of the contracts, and the id that ends each document.
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
#: UTF-8 bytes of texts that are encoded together, and distinct pieces and parts of pieces that a worker remembers.
BATCH_BYTES, MEMO_PIECES, MEMO_PARTS = 3 << 20, 150_000, 200_000

#: Kinds of characters below _KNOWN: letters, digits, marks, the space, line feeds; others (0) are left to the library. Apostrophes are, as
#: they begin contractions; so are letters beyond Latin Extended-A, and white space but for the two.
_LETTER, _DIGIT, _MARK, _SPACE, _LINE, _KNOWN = 1, 2, 3, 4, 5, 0x20AE
_KINDS = np.zeros(_KNOWN + 1, np.uint8)
_KINDS[[x for x in range(0x180) if chr(x).isalpha()]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[[x for x in [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)] if chr(x) != "'"]] = _MARK
_KINDS[[ord(x) for x in "¡¿«»§¶·°±×÷©®¢£¤¥¦¨¬¯´¸€"]] = _MARK
_KINDS[0x2010:0x2028] = _MARK
_KINDS[32], _KINDS[10] = _SPACE, _LINE


def resolve(name: str) -> str:
    """A vocabulary file's place on this machine: a path as it is, a bare name among the public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> np.ndarray:
    """The character that byte-level vocabularies write for each byte: itself if it prints in Latin-1, else the next one from 256 on."""
    prints = np.zeros(256, dtype=bool)
    prints[33:127] = prints[161:173] = prints[174:256] = True
    return np.where(prints, np.arange(256), 255 + np.cumsum(~prints)).astype("<u4")


class Pool:
    """Runs of ids by number."""

    def __init__(self) -> None:
        self.ids, self.used = np.empty(1 << 16, "<u4"), 0
        self.starts, self.sizes, self.runs = np.empty(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.add(np.empty(0, "<u4"), np.zeros(1, np.int64))  # run 0 is empty

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """Take in runs of these sizes, put together; returns the first one's number."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), "<u4")])
        while self.runs + len(sizes) > len(self.sizes):
            self.starts, self.sizes = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.sizes))
        first = self.runs
        self.ids[self.used : self.used + len(ids)] = ids
        self.sizes[first : first + len(sizes)] = sizes
        self.starts[first : first + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.used, self.runs = self.used + len(ids), first + len(sizes)
        return first

    def joined(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs, one after the other, and their sizes."""
        sizes = self.sizes[runs]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[runs] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes


class Encoder:
    """Ids of texts, put together from the ids of their pieces, which are remembered for as long as there is room."""

    def __init__(self, name: str):
        path = resolve(name)
        self.cuts = False
        self._clear()
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
            return
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        library = tokenizers.Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        self.encode = lambda texts: [x.ids for x in library.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        before, model, added = parts.get("pre_tokenizer") or {}, parts["model"], parts.get("added_tokens", [])
        letters = byte_letters()
        self.special = [x["content"] for x in added]
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not parts.get("normalizer")
        plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")) and all(chr(x) in model["vocab"] for x in letters)
        self.cuts = bool(byte_level and plain and not any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")) and not any(c.isspace() for x in self.special for c in x))
        if self.cuts:
            self.merges = tokenizers.Tokenizer(library.model)  # the same merges, on parts that are cut already
            self.merges.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
            self.letters = letters.copy()
            self.letters[0] = 32  # parts hold no zero byte; it stands between them
            self.size_of = np.zeros(library.get_vocab_size(), np.int64)  # bytes of each id
            for token, i in model["vocab"].items():
                self.size_of[i] = len(token)

    def _clear(self) -> None:
        self.pool, self.memo, self.first = Pool(), {}, {}  # pieces after a space; pieces as they are
        self.parts_pool, self.parts = Pool(), {}

    def pieces(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of the texts of a column: the pieces of all texts by their number in the pool, and how many each text has."""
        if not self.cuts:
            self._clear()
            texts = texts_of(column)
            coded = self.encode(texts) if texts else []
            sizes = np.array([len(x) for x in coded], np.int64)
            return self.pool.add(np.concatenate([np.empty(0, "<u4"), *(np.asarray(x, "<u4") for x in coded)]), sizes) + np.arange(len(texts)), np.ones(len(texts), np.int64)
        lists = pc.split_pattern(column.fill_null(""), " ")
        counts = lists.value_lengths().to_numpy().astype(np.int64)
        flat = lists.flatten()
        coded = flat.dictionary_encode()
        distinct, order = _strings(coded.dictionary), coded.indices.to_numpy()
        if len(self.memo) + len(self.first) > MEMO_PIECES:
            self._keep(distinct)
        memo = self.memo
        # A piece that is empty or ends in white space has no safe boundary after it; it's put together with those that follow.
        new = [x for x in distinct if x not in memo and x and not x[-1].isspace()]
        memo.update(zip(new, self._learned(new, spaced=True).tolist(), strict=True))
        numbers = np.fromiter(map(memo.get, distinct, repeat(-1)), np.int64, len(distinct))
        order = numbers[order]
        at = np.cumsum(counts) - counts
        heads = flat.take(pa.array(at)).to_pylist()
        alone = [x for x, n in zip(heads, counts.tolist(), strict=True) if x and (n == 1 or not x[-1].isspace())]
        self._learn(alone)
        open_ = order < 0
        order[at] = [self.first.get(x, 0) for x in heads]
        open_[at] = [n > 1 and (not x or x[-1].isspace()) for x, n in zip(heads, counts.tolist(), strict=True)]
        if open_.any():
            self._join_open(flat, order, open_, at, counts)
        return order, counts

    def _join_open(self, flat: pa.Array, order: np.ndarray, open_: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
        """Put each run of open pieces and the piece after it, as far as the text goes, together as one; the others of the run are empty."""
        last = np.zeros(len(order), dtype=bool)
        last[at + counts - 1] = True
        goes_on = open_ & ~last
        starts = np.flatnonzero((goes_on | open_) & ~np.append(False, goes_on[:-1]))
        stops = np.flatnonzero(~goes_on)
        stops = stops[np.searchsorted(stops, starts)]
        head = np.zeros(len(order), dtype=bool)
        head[at] = True
        rows = np.repeat(starts - np.cumsum(stops - starts + 1) + stops - starts + 1, stops - starts + 1) + np.arange(int((stops - starts + 1).sum()))
        words, joined, place = flat.take(pa.array(rows)).to_pylist(), [], 0
        for n, is_head in zip((stops - starts + 1).tolist(), head[starts].tolist(), strict=True):
            joined.append(("" if is_head else " ") + " ".join(words[place : place + n]))
            place += n
        self._learn(joined)
        order[rows] = 0
        order[starts] = [self.first.get(x, 0) for x in joined]

    def _keep(self, distinct: list[str]) -> None:
        """Forget all pieces but those of this batch."""
        memo, pool = self.memo, self.pool
        names = [x for x in distinct if x in memo]
        self.pool, self.memo, self.first = Pool(), {}, {}
        first = self.pool.add(*pool.joined(np.array([memo[x] for x in names], np.int64)))
        self.memo = dict(zip(names, range(first, first + len(names)), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Pieces as they are."""
        new = list({x for x in pieces if x not in self.first})
        self.first.update(zip(new, self._learned(new, spaced=False).tolist(), strict=True))

    def _learned(self, pieces: list[str], spaced: bool) -> np.ndarray:
        """Numbers of distinct pieces in the pool; spaced: a space goes before each."""
        out = np.zeros(len(pieces), np.int64)
        if not pieces:
            return out
        mark = "\x00 " if spaced else "\x00"
        whole = mark[1:] + mark.join(pieces) + "\x00"
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, between = _KINDS[np.minimum(codes, _KNOWN)], codes == 0
        ends = np.flatnonzero(between)
        if len(ends) != len(pieces):  # zero characters within pieces
            fast = np.array(["\x00" not in x for x in pieces])
            some = np.flatnonzero(fast)
            out[some] = self._learned([pieces[i] for i in some.tolist()], spaced)
        else:
            space = (kinds == _SPACE) | (kinds == _LINE)
            bad = (kinds == 0) & ~between
            bad[1:] |= space[1:] & space[:-1]  # white space together is cut by other rules
            bad[:-1] |= space[:-1] & between[1:]
            sums = np.append(0, np.cumsum(bad))
            begins = np.append(0, ends[:-1] + 1)
            fast = sums[ends] == sums[begins]
            if any(x in whole for x in self.special):
                fast &= ~np.array([any(y in x for y in self.special) for x in pieces])
            cut = np.ones(len(kinds), dtype=bool)
            cut[1:] = (kinds[1:] != kinds[:-1]) & (kinds[:-1] != _SPACE) | between[:-1]
            cut &= np.repeat(fast, ends + 1 - begins)
            firsts = np.flatnonzero(cut & ~between)
            edges = np.flatnonzero(cut | between)
            lasts = edges[np.searchsorted(edges, firsts) + 1]
            names = [whole[i:j] for i, j in zip(firsts.tolist(), lasts.tolist(), strict=True)]
            numbers = self._part_numbers(names)
            ids, sizes = self.parts_pool.joined(numbers)
            some = np.flatnonzero(fast)
            if len(some):
                of_piece = np.add.reduceat(sizes, np.searchsorted(firsts, begins[some]))
                out[some] = self.pool.add(ids, of_piece) + np.arange(len(some))
        rest = np.flatnonzero(~fast).tolist()
        for part in balanced([len(pieces[i]) for i in rest], 1 << 16):
            coded = self.encode([mark[1:] + pieces[i] for i in rest[part]])
            out[rest[part]] = self.pool.add(np.concatenate([np.asarray(x, "<u4") for x in coded]), np.array([len(x) for x in coded], np.int64)) + np.arange(len(coded))
        return out

    def _part_numbers(self, names: list[str]) -> np.ndarray:
        """Numbers of parts in their pool; the library's merges run on those that are new."""
        if len(self.parts) > MEMO_PARTS:
            self.parts_pool, self.parts = Pool(), {}
        known = self.parts
        new = list({x for x in names if x not in known})
        for part in balanced([len(x) for x in new], 1 << 13):
            data = "\x00".join(new[part]).encode()
            raw = np.frombuffer(data, np.uint8)
            ids = np.asarray(self.merges.encode_batch_fast([self.letters[raw].tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
            stops = np.append(np.flatnonzero(raw == 0), len(raw)) - np.arange(len(new[part]))  # bytes up to each part's end
            sizes = np.diff(np.searchsorted(np.cumsum(self.size_of[ids]), stops, "right"), prepend=0)
            first = self.parts_pool.add(ids, sizes)
            known.update(zip(new[part], range(first, first + len(sizes)), strict=True))
        return np.fromiter(map(known.__getitem__, names), np.int64, len(names))

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        out = [np.empty(0, np.int64)]
        for part in balanced(_sizes(column), BATCH_BYTES):
            order, pieces = self.pieces(column[part])
            out.append(np.add.reduceat(self.pool.sizes[order], np.cumsum(pieces) - pieces))
        return np.concatenate(out)

    def ids(self, column: pa.Array, batch_bytes: int = BATCH_BYTES) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for part in balanced(_sizes(column), batch_bytes):
            order, pieces = self.pieces(column[part])
            ids, taken = self.pool.joined(order)
            texts = np.append(0, np.add.reduceat(taken, np.cumsum(pieces) - pieces).cumsum())
            yield from (ids[i:j] for i, j in zip(texts[:-1].tolist(), texts[1:].tolist(), strict=True))


def _strings(pieces: pa.Array) -> list[str]:
    """Python strings of texts without spaces."""
    if not len(pieces):
        return []
    listed = pa.LargeListArray if pa.types.is_large_string(pieces.type) else pa.ListArray
    return pc.binary_join(listed.from_arrays([0, len(pieces)], pieces), " ")[0].as_py().split(" ")


def _sizes(column: pa.Array) -> list[int]:
    return pc.binary_length(column).fill_null(0).to_pylist()


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(name: str) -> Encoder:
    """This worker's encoder for a vocabulary."""
    if name not in _ENCODERS:
        release_memory()
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of a text without added special tokens; null counts as the empty text, 0."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoder_of(tokenizer)
        for column in batches:
            yield pa.array(encoder.counts(column), pa.int64())

    return count(text)


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = 1024) -> DataFrame:
    """A row per document: id, n_bytes, n_tokens, over_limit (more than limit tokens).

    Nulls: a null text is the empty text (0 bytes, 0 tokens), a null id stays null. Repeated rows and ids give a row each;
    an empty table gives none. Further columns are not read. Texts of any length are counted whole.
    """
    bound_batches(documents.sparkSession)
    text = F.col(f"`{text_col}`")
    counted = documents.select(F.col(f"`{id_col}`").alias(id_col), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), token_count(text, tokenizer).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
