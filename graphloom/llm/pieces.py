"""Oversized texts cut into pieces at natural boundaries, by byte ranges that any worker can process.

A text, or a file, is cut into ranges of RANGE bytes with a halo of HALO more; no worker needs the rest of it. A worker moves a range's start and end to the next place where a
word of the tokenizer must end whatever came before (a space after something else, or a change from letters or digits to something else), so words and tokens
of all ranges together are those of the whole text. It writes the range's tokens and a table of its boundaries: paragraph, sentence and
word ends by token offset. The tables of a text, without its tokens, are read in order as a stream and stitched by the running sum of their lengths; pieces are chosen on them as soon
as they are complete, and take their tokens from the ranges they touch, by offset. A range whose last word goes on past its halo is processed again with a longer one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.bpe import encoder, vocabulary_path
from graphloom.llm.tokens import groups
from graphloom.storage import materialize, spread

#: Bytes of a range and its halo; how many times longer the halo of a range is in each further try.
RANGE, HALO, LONGER = 16_384, 2_048, 8
#: Bytes kept before a range: the longest character.
_BEFORE = 4
KINDS = ("inside a word", "between words", "word", "sentence", "paragraph")
_SYNC = r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\s\p{L}])|(?<=\p{N})(?=[^\s\p{N}])"
_SENTENCE = frozenset(".!?…。！？")
_CLOSERS = "\"')]}»”’」』）"


def boundaries(words: list[str], after: str, counts: list[int]) -> list[int]:
    """The end of each word as token offset * 8 + kind (an index of KINDS, from 1); `after` is the character after the last word, or empty at the end of the text."""
    out, at, lines, ended = [], 0, 0, False
    last = len(words) - 1
    for i, (w, n) in enumerate(zip(words, counts)):
        at += n
        nxt = words[i + 1][0] if i < last else after
        blank = w.isspace()
        if blank:
            lines += w.count("\n")
        else:
            lines = 0
            core = w.rstrip(_CLOSERS)
            ended = core[-1] in _SENTENCE if core else ended
        if not nxt:
            break
        if blank:
            kind = 4 if lines >= 2 else 3 if lines or ended else 2
        elif nxt.isspace():
            kind = 3 if ended else 2
        elif ended and w.strip()[-1] in "。！？":
            kind = 3
        else:
            kind = 1
        out.append(at * 8 + kind)
    return out


def _ranges_of(documents: DataFrame, size: int, halo: int) -> DataFrame:
    """(row, doc_id, range_no, raw, final, ends) of texts (row, doc_id, text): each range's bytes with those before and its halo, cut out without reading what lies before it.

    `final`: the text ends within these bytes; `ends`: it ends within the range itself.
    """
    whole = documents.select("row", "doc_id", F.col("text").cast("binary").alias("bytes"), F.octet_length("text").alias("n"))
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))
    rows = whole.select("row", "doc_id", "bytes", "n", F.explode(F.sequence(F.lit(0), last)).alias("range_no"))
    raw = F.expr(f"substring(bytes, greatest(range_no * {size} - {_BEFORE}, 0) + 1, least(range_no, 1) * {_BEFORE} + {size + halo})")
    return rows.select("row", "doc_id", "range_no", raw.alias("raw"), (F.col("range_no") * size + size + halo >= F.col("n")).alias("final"), (F.col("range_no") == last).alias("ends"))


def _lead(raw: bytes, at: int) -> int:
    """The first place from `at` on where a character begins."""
    while at < len(raw) and 0x80 <= raw[at] < 0xC0:
        at += 1
    return at


def window(raw: bytes, no: int, size: int, final: bool) -> tuple[str, int, int]:
    """The text of a range's bytes (from the character before it), and where in it the range begins and where its halo."""
    begin = _lead(raw, _BEFORE if no else 0)
    back = begin - 1
    while back > 0 and 0x80 <= raw[back] < 0xC0:
        back -= 1
    end = min(len(raw), _lead(raw, (_BEFORE if no else 0) + size))
    before = raw[back:begin].decode("utf-8", "replace") if no else ""
    body, after = raw[begin:end].decode("utf-8", "replace"), raw[end:].decode("utf-8", "replace" if final else "ignore")
    return before + body + after, len(before), len(before) + len(body)


def _lists(parts: list[list[int]]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(y) for y in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter((i for y in parts for i in y), dtype=np.int32, count=int(ends[-1]))))


def _tokenize(path: str, size: int, lengths_only: bool):
    """Rows (row, doc_id, range_no, n, open) and, unless only lengths are asked, ids and cuts; `open` marks a range that needs a longer halo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        sync, work = regex.compile(_SYNC), encoder(path)
        for batch in batches:
            for a, b in groups([range(n) for n in pc.binary_length(batch.column("raw")).to_pylist()]):
                sub = batch.slice(a, b - a)
                words, after, is_open = [], [], []
                for raw, no, final in zip(sub.column("raw").to_pylist(), sub.column("range_no").to_pylist(), sub.column("final").to_pylist()):
                    text, skip, halo = window(raw, no, size, final)
                    begin, end, miss = 0, len(text), False
                    if no:
                        m = sync.search(text, skip)
                        begin = m.start() if m and m.start() < halo else -1
                    if begin >= 0 and (halo < len(text) or not final):
                        m = sync.search(text, halo)
                        if m and m.start() < len(text):
                            end = m.start()
                        else:
                            miss = not final
                    mine = begin >= 0 and not miss
                    words.append(work.split(text[begin:end]) if mine else [])
                    after.append(text[end : end + 1] if mine else "")
                    is_open.append(miss)
                known = work.learn(words)
                counts = [[len(known[w]) for w in x] for x in words]
                columns = [sub.column("row"), sub.column("doc_id"), sub.column("range_no"), pa.array([sum(c) for c in counts], pa.int64()), pa.array(is_open)]
                names = ["row", "doc_id", "range_no", "n", "open"]
                if not lengths_only:
                    columns += [_lists([[i for w in x for i in known[w]] for x in words]), _lists([boundaries(x, y, c) for x, y, c in zip(words, after, counts)])]
                    names += ["ids", "cuts"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _tokenized(ranges: DataFrame, path: str, size: int, halo: int, lengths_only: bool) -> DataFrame:
    """The tokens of all ranges; those whose last word goes on past the halo are tried again, with bytes of the ranges after them, until it ends."""
    shape = f"row bigint, doc_id {dict(ranges.dtypes)['doc_id']}, range_no int, n bigint, open boolean" + ("" if lengths_only else ", ids array<int>, cuts array<int>")
    table = materialize(ranges.mapInArrow(_tokenize(path, size, lengths_only), shape))
    done, again = table.where("not open"), table.where("open").select("row", "range_no")
    while not again.isEmpty():
        halo *= LONGER
        more = -(-halo // size)
        need = again.select("row", F.col("range_no").alias("to"), F.explode(F.sequence(F.col("range_no"), F.col("range_no") + more)).alias("range_no"))
        own = F.when(F.col("range_no") == F.col("to"), F.expr(f"substring(raw, 1, least(range_no, 1) * {_BEFORE} + {size})")).otherwise(F.expr(f"substring(raw, {_BEFORE} + 1, {size})"))
        parts = ranges.join(need, ["row", "range_no"]).select("row", "doc_id", "to", F.struct("range_no", own.alias("raw"), "ends").alias("z"))
        joined = parts.groupBy("row", "doc_id", "to").agg(F.array_sort(F.collect_list("z")).alias("z"))  # LONGER times as long as the word at most
        whole = joined.select("row", "doc_id", F.col("to").alias("range_no"), F.expr("aggregate(z, cast('' as binary), (a, x) -> concat(a, x.raw))").alias("raw"), F.element_at("z", -1)["ends"].alias("final"))
        step = materialize(whole.mapInArrow(_tokenize(path, size, lengths_only), shape))
        done = done.unionByName(step.where("not open"))
        again = step.where("open").select("row", "range_no")
    return done


def cut_at(at: np.ndarray, kind: np.ndarray, start: int, limit: int, overlap: int) -> tuple[int, int]:
    """(token after its last, kind of its end) of a piece that begins at a token and can't hold all that follows; `at`, `kind`: the boundaries, at least all up to start + limit.

    A piece ends at the last paragraph end in its second half, else at the last sentence end there, else at the last word end anywhere past the overlap, else
    between words, else at the limit.
    """
    inside = slice(np.searchsorted(at, start, side="right"), np.searchsorted(at, start + limit, side="right"))
    at, kind = at[inside], kind[inside]
    half = start + max(limit // 2, overlap + 1)
    for k, least in ((4, half), (3, half), (2, start + overlap + 1), (1, start + overlap + 1)):
        i = np.flatnonzero((kind >= k) & (at >= least))
        if len(i):
            return int(at[i[-1]]), k
    return start + limit, 0


class _Text:
    """One text's boundary tables, as they come in order of their ranges; only those a piece can still need are kept."""

    def __init__(self, row: int, doc_id, limit: int, overlap: int):
        self.row, self.doc_id, self.limit, self.overlap = row, doc_id, limit, overlap
        self.start = self.seen = self.piece = 0
        self.at, self.kind = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ranges: list[tuple[int, int, int]] = []  # (range_no, first token, token after its last)

    def add(self, range_no: int, n: int, cuts: np.ndarray) -> list[tuple]:
        if not n:
            return []
        self.at, self.kind = np.concatenate((self.at, (cuts >> 3) + self.seen)), np.concatenate((self.kind, cuts & 7))
        self.ranges.append((range_no, self.seen, self.seen + n))
        self.seen += n
        out = []
        while self.seen - self.start > self.limit:
            end, how = cut_at(self.at, self.kind, self.start, self.limit, self.overlap)
            out += self._piece(end, how)
            self.start = end - self.overlap
        keep = np.searchsorted(self.at, self.start, side="right")
        self.at, self.kind = self.at[keep:], self.kind[keep:]
        self.ranges = [r for r in self.ranges if r[2] > self.start]
        return out

    def _piece(self, end: int, how: int) -> list[tuple]:
        start, no = self.start, self.piece
        self.piece += 1
        return [(self.row, self.doc_id, no, start, end - start, KINDS[how], r, max(start, a) - a, min(end, z) - a) for r, a, z in self.ranges if a < end and z > start]

    def close(self) -> list[tuple]:
        return self._piece(self.seen, 4) if self.seen > self.start else []


def _stitch(limit: int, overlap: int):
    """Pieces of texts whose boundary tables come sorted by text and range, however many ranges a text has."""
    names = ["row", "doc_id", "piece_no", "token_start", "n_tokens", "cut_at", "range_no", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, id_type = None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

        for batch in batches:
            id_type, out = batch.column("doc_id").type, []
            cuts = batch.column("cuts")
            offsets, flat = cuts.offsets.to_numpy(), cuts.values.to_numpy().astype(np.int64)
            for i, (row, doc_id, no, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "range_no", "n")))):
                if text is None or text.row != row:
                    out += text.close() if text else []
                    text = _Text(row, doc_id, limit, overlap)
                out += text.add(no, n, flat[offsets[i] : offsets[i + 1]])
            if out:
                yield made(out)
        if text and (out := text.close()):
            yield made(out)

    return run


def _texts(documents: DataFrame, least: int, id_col: str, text_col: str) -> DataFrame:
    """(row, doc_id, text) of the texts of more than so many bytes: a token has at least one byte, so shorter ones can't exceed a limit of as many tokens."""
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(F.octet_length("text") > least)


def _of_texts(documents: DataFrame, limit: int, id_col: str, text_col: str, size: int, halo: int) -> DataFrame:
    return materialize(spread(_ranges_of(_texts(documents, limit, id_col, text_col), size, halo), "row", "range_no"))


def _of_files(spark: SparkSession, paths: str | list[str], size: int, halo: int) -> DataFrame:
    """The ranges of files: each is read by seeking to it, so no worker loads a file."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("n"))  # the content is not read
    files = files.select(F.xxhash64("path").alias("row"), F.col("path").alias("doc_id"), "n")
    last = F.greatest(F.lit(0), F.floor((F.col("n") - 1) / size).cast("int"))
    ranges = files.select("row", "doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("range_no"), last.alias("last"))
    ranges = ranges.select("row", "doc_id", "range_no", (F.col("range_no") * F.lit(size).cast("bigint") + size + halo >= F.col("n")).alias("final"), (F.col("range_no") == F.col("last")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            raw = []
            for path, no in zip(batch.column("doc_id").to_pylist(), batch.column("range_no").to_pylist()):
                system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path)
                with system.open_input_file(at) as f:
                    f.seek(max(0, no * size - _BEFORE))
                    raw.append(f.read((_BEFORE if no else 0) + size + halo))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, "raw"])

    return materialize(ranges.repartition("row", "range_no").mapInArrow(run, "row bigint, doc_id string, range_no int, final boolean, ends boolean, raw binary").select("row", "doc_id", "range_no", "raw", "final", "ends"))


def _pieces(ranges: DataFrame, limit: int, overlap: int, tokenizers: str | None, size: int, halo: int) -> DataFrame:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of the limit")
    table = _tokenized(ranges, vocabulary_path(tokenizers), size, halo, False)
    large = table.groupBy("row").agg(F.sum("n").alias("total")).where(F.col("total") > limit).select("row")
    heads = table.select("row", "doc_id", "range_no", "n", "cuts").join(large, "row", "left_semi").repartition("row").sortWithinPartitions("row", "range_no")
    shape = f"row bigint, doc_id {dict(ranges.dtypes)['doc_id']}, piece_no bigint, token_start bigint, n_tokens bigint, cut_at string, range_no int, lo int, hi int"
    touched = materialize(heads.mapInArrow(_stitch(limit, overlap), shape))
    parts = touched.join(table.select("row", "range_no", "ids"), ["row", "range_no"]).withColumn("part", F.struct("range_no", F.expr("slice(ids, lo + 1, hi - lo)").alias("ids")))
    whole = parts.groupBy("row", "doc_id", "piece_no", "token_start", "n_tokens", "cut_at").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # `limit` tokens at most
    return whole.select("doc_id", "piece_no", "token_start", "n_tokens", "cut_at", F.flatten(F.col("parts.ids")).cast("array<bigint>").alias("ids"))


def pieces(documents: DataFrame, limit: int = 1024, overlap: int = 64, id_col: str = "doc_id", text_col: str = "text", tokenizers: str | None = None, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """`doc_id`, `piece_no`, `token_start`, `n_tokens`, `cut_at` (what its end is; the last piece ends a paragraph), `ids`: pieces of the texts of more than `limit` tokens.

    Pieces have at most `limit` tokens and follow each other with exactly `overlap` shared tokens, so dropping those gives the text's tokens again.
    Texts up to the limit, empty and null ones give no row; repeated doc_ids are separate texts.
    """
    return _pieces(_of_texts(documents, limit, id_col, text_col, size, halo), limit, overlap, tokenizers, size, halo)


def pieces_of_files(spark: SparkSession, paths: str | list[str], limit: int = 1024, overlap: int = 64, tokenizers: str | None = None, size: int = RANGE, halo: int = HALO) -> DataFrame:
    """The same of UTF-8 files, each a text, in a folder that all executors share; `doc_id` is the file's address. Files up to the limit and empty ones give no row."""
    return _pieces(_of_files(spark, paths, size, halo), limit, overlap, tokenizers, size, halo)


def found(documents: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", tokenizers: str | None = None) -> DataFrame:
    """`doc_id` of each text that is cut into pieces: the lengths of its ranges add up to more than the limit."""
    lengths = _tokenized(_of_texts(documents, limit, id_col, text_col, RANGE, HALO), vocabulary_path(tokenizers), RANGE, HALO, True)
    return lengths.groupBy("row", "doc_id").agg(F.sum("n").alias("total")).where(F.col("total") > limit).select("doc_id").distinct()


def with_text(cut: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """Adds `text`, the pieces' tokens as text; a character whose bytes lie in two pieces is replaced by U+FFFD in both."""
    path = vocabulary_path(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path).vocabulary.tokens
        for batch in batches:
            text = [b"".join([tokens[i] for i in ids]).decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])

    return cut.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", text string")
