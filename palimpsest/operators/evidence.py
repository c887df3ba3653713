"""Evidence of files: bytes in, typed rows out, in one pass that no file can fail.

``described`` works out what needs the whole bytes in Spark (hash, type, PDF markers). ``inspected`` hands the bytes of files
within the limit to the kernels and gives one table of rows by kind: file, entry, stream, string, text, rect, body. Rows leave in
batches bounded by rows and bytes while a file is still read; its file row comes last and says whether anything went wrong, and
``without_failed`` drops what had left of a file that failed.

A PDF whose streams decode to more than ``SPREAD`` bytes is not read through by the task that opened it: that task only finds and
measures its streams (the budget over all streams of a file is kept there, by sizes alone), and each stream within the budget
becomes a body row with its encoded bytes. ``unfolded`` deals those out by file and stream, so that one file keeps all cores busy.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import DARK, PAGE, PALE
from ..functions.text import extension_of
from ..sources import archives, content, images, pdf
from . import pdf_rules

POWERPOINT = ("pptx", "pptm", "ppsx", "ppsm", "potx", "potm")
MAX_BYTES = 512 << 20

FILE = "file_id string, name string, type string, size bigint, sha256 string, extension string, detected string, too_large boolean, marks string"
OUTCOME = "failure string, duration_ms bigint"
ENTRY = ("file_id string, idx int, name string, packed bigint, unpacked bigint, method int, crc bigint, flags int, directory boolean, zip64 boolean, "
         "text string, error string, zip_error boolean, fields array<struct<name:string,value:string>>, latitude double, longitude double, "
         "part boolean, whole boolean")
PDF = ("file_id string, kind string, stream int, seq int, key string, text string, left double, right double, bottom double, top double, "
       "render_mode double, r double, g double, b double, size bigint")
BODY = PDF + ", raw binary"
WANTED = (".xml", ".rels")
#: The parts that a presentation must have.
NEED = ("[Content_Types].xml", "ppt/presentation.xml")
#: Rows of one batch that leaves the kernels, and bytes after which one does.
AT_ONCE, BYTES_AT_ONCE = 10_000, 8 << 20
#: Decoded bytes beyond which a file's streams are dealt out, and about how many a task then takes.
SPREAD = 8 << 20
#: Characters kept of a string, white space squeezed; rules show far fewer.
SHOWN = 4000
RAW_KEYS = ("Author", "Creator", "Producer", "F", "UF", "V", "DV", "Contents")
STREAM_KEYS = ("Author", "Creator", "Producer")


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: All columns of the table, each once.
ALL = list({c.split()[0]: c for schema in (BODY, ENTRY, FILE, OUTCOME) for c in schema.split(", ")}.values())
ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(),
         "array<struct<name:string,value:string>>": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))}
COLUMNS = {c.split()[0]: ARROW[c.split(" ", 1)[1]] for c in ALL}


def described(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(name, content) as FILE columns and content (null where it is not to be decoded); ``marks`` are the PDF markers as JSON.

    ``file_id`` is taken from the input if it has one, which must be unique. Else each row has one of its own, its name and place, so
    that files of one name stay apart; the place is fixed once the table is written. ``type`` is the declared type, if given.
    """
    head = F.hex(F.substring("content", 1, 8))
    detected = F.when(head.startswith("255044462D"), "pdf").when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(
        head == "D0CF11E0A1B11AE1", "ole").otherwise("unknown")
    size = F.octet_length("content").cast("bigint")
    own = F.col("file_id").cast("string") if "file_id" in files.columns else F.concat("name", F.lit("#"), F.monotonically_increasing_id().cast("string"))
    type_ = F.col("type") if "type" in files.columns else F.lit("")
    rows = files.select(own.alias("file_id"), "name", type_.alias("type"), size.alias("size"), F.sha2("content", 256).alias("sha256"),
                        extension_of(F.col("name")).alias("extension"), detected.alias("detected"), (size > max_bytes).alias("too_large"), "content")
    fits = ~F.col("too_large") & F.col("detected").isin("pdf", "zip")
    is_pdf = ~F.col("too_large") & (F.col("detected") == "pdf")
    rows = rows.withColumns({"marks": F.when(is_pdf, F.to_json(pdf_rules.marks(F.decode("content", "ISO-8859-1")))), "content": F.when(fits, F.col("content"))})
    return rows.select(*names(FILE), "content")


class Batches:
    """Rows on their way out of a task: record batches once there are enough of them, by rows or bytes.

    Shown texts and filled paths wait as the kernel noted them and get their boxes together. A row that cannot be written makes
    its file fail, and nobody else's; so file rows leave after all others.
    """

    def __init__(self, needed_only: bool) -> None:
        self.needed_only = needed_only
        self.rows: dict[str, list[tuple]] = {PDF: [], ENTRY: [], BODY: []}
        self.pages: list[tuple[str, int, content.Page]] = []
        self.files: list[tuple] = []
        self.count = self.weight = 0

    def add(self, schema: str, row: tuple, weight: int = 0) -> None:
        self.rows[schema].append(row)
        self.count += 1
        self.weight += weight

    def add_page(self, file_id: str, stream: int, page: content.Page) -> None:
        if page.texts or page.filled:
            self.pages.append((file_id, stream, page))
            self.count += len(page.texts) + len(page.filled)

    def full(self) -> bool:
        return self.count >= AT_ONCE or self.weight >= BYTES_AT_ONCE or len(self.files) >= AT_ONCE

    def take(self) -> Iterator[pa.RecordBatch]:
        """All that waits."""
        broken: dict[str, str] = {}
        for schema, rows in self.rows.items():
            for at in range(0, len(rows), AT_ONCE):
                yield from safe_tables(rows[at: at + AT_ONCE], schema, broken)
        yield from page_tables(self.pages, self.needed_only)
        done = [(*f[:-2], f[-2] or broken.get(f[0]), f[-1]) for f in self.files]
        late = [(i, *(None,) * (len(names(FILE)) - 1), why, 0) for i, why in broken.items() if i not in {f[0] for f in self.files}]
        if done or late:
            yield table_of(done + late, [*names(FILE), *names(OUTCOME)], "file")
        self.rows, self.pages, self.files, self.count, self.weight = {k: [] for k in self.rows}, [], [], 0, 0


def safe_tables(rows: list[tuple], schema: str, broken: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The rows as a batch; if some cannot be written, each that can as its own, the others' files noted in ``broken``."""
    try:
        yield table_of(rows, names(schema), "entry" if schema == ENTRY else None)
    except (pa.ArrowException, OverflowError, TypeError, ValueError) as e:
        if len(rows) == 1:
            broken[rows[0][0]] = str(e) or type(e).__name__
            return
        half = len(rows) // 2
        for part in (rows[:half], rows[half:]):
            yield from safe_tables(part, schema, broken)


def package_rows(file_id: str, data: bytes, out: Batches) -> Iterator[pa.RecordBatch]:
    """ENTRY rows: each entry with its XML text or image metadata, and whether it is a part (of equal names the last is) of a
    package that has the required parts; a package that cannot be opened is one row, idx -1."""
    try:
        package = archives.open_package(data)
    except archives.PackageError as e:
        out.add(ENTRY, (file_id, -1, None, 0, 0, 0, 0, 0, False, False, None, str(e), True, None, None, None, False, False))
        return
    last = {e.name: i for i, e in enumerate(package.entries)}  # of equal names the last is the part
    whole = all(n in last for n in NEED)
    for i, e in enumerate(package.entries):
        text = error = fields = lat = lon = None
        zip_error = False
        media = e.name.startswith("ppt/media/")
        try:
            if last[e.name] == i and e.name.lower().endswith(WANTED) and e.unpacked <= archives.XML_BYTES:
                text = package.read(e).decode("utf-8-sig", "replace")
            elif media and not e.directory and e.unpacked <= archives.MEDIA_BYTES:
                found = images.metadata(package.read(e))
                if found:
                    fields = [{"name": k, "value": v} for k, v in found[0].items()]
                    lat, lon = found[1] or (None, None)
        except (archives.PackageError, ValueError) as x:
            error, zip_error = str(x), isinstance(x, archives.PackageError)
        out.add(ENTRY, (file_id, i, e.name, e.packed, e.unpacked, e.method, e.crc, e.flags, e.directory, package.zip64, text, error, zip_error, fields, lat, lon, last[e.name] == i, whole), len(text or ""))
        if out.full():
            yield from out.take()


NONE = (None,) * 9


def put_strings(file_id: str, stream: int, source: str, keys: tuple[str, ...], out: Batches) -> None:
    for key in keys:
        if "/" + key in source:
            for seq, value in enumerate(pdf.keyed_strings(source, key)):
                value = content.squeeze(value.replace("\0", " "), SHOWN) if len(value) > SHOWN else value.replace("\0", " ")
                out.add(PDF, (file_id, "string", stream, seq, key, value, *NONE), len(value))


def put_stream(file_id: str, stream: int, body: bytes, out: Batches) -> None:
    """What a decoded stream shows, fills and tells."""
    inner = body.decode("latin-1")
    out.add_page(file_id, stream, content.interpret(inner))
    put_strings(file_id, stream, inner, STREAM_KEYS, out)


def pdf_rows(file_id: str, data: bytes, out: Batches) -> Iterator[pa.RecordBatch]:
    """PDF rows of kind stream (key: status), string (stream 0: the raw file), text and rect, or of kind body instead of a large file's last."""
    source = data.decode("latin-1")
    put_strings(file_id, 0, source, RAW_KEYS, out)
    total, held = 0, []  # while the file is small, (stream, encoded, decoded) of its streams
    spread = False
    for s in pdf.streams(source):
        status, body = "decoded", b""
        if total >= pdf.ALL_BYTES:
            out.add(PDF, (file_id, "stream", s.index, 0, "over", None, *NONE))
            break
        try:
            body = pdf.decoded(s.raw, s.filters)
        except pdf.Unsupported:
            status = "unsupported"
        except ValueError:
            status = "failed"
        out.add(PDF, (file_id, "stream", s.index, 0, status, None, *NONE[:-1], len(body) if status == "decoded" else None))
        if status == "decoded":
            total += len(body)
            held.append((s, body))
            spread = spread or total > SPREAD
            if spread:
                for part, inner in held:
                    out.add(BODY, (file_id, "body", part.index, 0, " ".join(part.filters), None, *NONE[:-1], len(inner), part.raw), len(part.raw))
                held = []
        if out.full():
            yield from out.take()
    for s, body in held:
        put_stream(file_id, s.index, body, out)
        if out.full():
            yield from out.take()


def ranks(group: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row where ``wanted`` holds its number, from 1, among those of its group; groups stand together."""
    running = np.cumsum(wanted)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    before = np.concatenate(([0], running))[first]
    return running - np.repeat(before, np.diff(np.concatenate((first, [len(group)]))))


def needed(stream: np.ndarray, box: np.ndarray, shown: np.ndarray, dark_stream: np.ndarray, dark_box: np.ndarray) -> np.ndarray:
    """Which texts a rule can name: the first of each kind in a stream, and visible ones within the bounds of its dark rectangles."""
    left, right, bottom, top = box.T
    unseen = np.isin(shown[:, 8], (3, 7))
    off = (right < PAGE[0]) | (left > PAGE[1]) | (top < PAGE[2]) | (bottom > PAGE[3])
    pale = ~unseen & (shown[:, 9:] >= PALE).all(1)
    out = np.zeros(len(stream), bool)
    for kind, what in (("invisible", unseen), ("off", off), ("pale", pale)):
        out |= what & (ranks(stream, what) <= pdf_rules.CAPS[kind])
    if len(dark_stream):
        first = np.flatnonzero(np.concatenate(([True], dark_stream[1:] != dark_stream[:-1])))
        low, high = (f.reduceat(dark_box, first) for f in (np.fmin, np.fmax))
        at = np.searchsorted(dark_stream[first], stream)
        there = (at < len(first)) & (dark_stream[first][np.minimum(at, len(first) - 1)] == stream)
        at = np.minimum(at, len(first) - 1)
        middle = (bottom + top) / 2
        out |= there & ~unseen & (left <= high[at, 1]) & (right >= low[at, 0]) & (middle >= low[at, 2]) & (middle <= high[at, 3])
    return out


def page_tables(pages: list[tuple[str, int, content.Page]], needed_only: bool) -> Iterator[pa.RecordBatch]:
    """text and rect rows of the pages, boxes worked out for all at once; with ``needed_only`` those that a rule can name."""
    if not pages:
        return
    ids, numbers = np.array([p[0] for p in pages], object), np.array([p[1] for p in pages], np.int32)

    def columns(kind: str):
        of = [p[2].texts if kind == "text" else p[2].filled for p in pages]
        sizes = [len(x) for x in of]
        page = np.repeat(np.arange(len(pages)), sizes)
        seq = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        values = np.array([v for p in pages for v in (p[2].shown if kind == "text" else p[2].filled)], float).reshape(len(page), 12 if kind == "text" else 13)
        return page, seq, values

    with np.errstate(all="ignore"):
        (t_page, t_seq, shown), (r_page, r_seq, filled) = columns("text"), columns("rect")
        t_box, r_box = content.text_boxes(shown), content.path_boxes(filled)
        texts = [t for p in pages for t in p[2].texts]
        t_keep, r_keep = np.arange(len(texts)), np.arange(len(r_seq))
        if needed_only:
            r_keep = np.flatnonzero((filled[:, 10:] <= DARK).all(1))
            t_keep = np.flatnonzero(needed(t_page, t_box, shown, r_page[r_keep], r_box[r_keep]))
    for kind, keep, page, seq, box, fill, mode in (("text", t_keep, t_page, t_seq, t_box, shown[:, 9:], shown[:, 8]), ("rect", r_keep, r_page, r_seq, r_box, filled[:, 10:], None)):
        for begin in range(0, len(keep), AT_ONCE):
            k = keep[begin: begin + AT_ONCE]
            sides = dict(zip(("left", "right", "bottom", "top"), box[k].T))
            given = {"file_id": ids[page[k]], "kind": [kind] * len(k), "stream": numbers[page[k]], "seq": seq[k], **sides, **dict(zip("rgb", fill[k].T))}
            if kind == "text":
                given |= {"text": [texts[i].replace("\0", " ") for i in k], "render_mode": mode[k]}
            yield batch_of(given, len(k))


def batch_of(given: dict, n: int) -> pa.RecordBatch:
    """The columns under the common ones; lone surrogates, which no column can hold, become question marks."""
    def array(name: str, type_: pa.DataType) -> pa.Array:
        if name not in given:
            return pa.nulls(n, type_)
        values = given[name]
        try:
            return pa.array(values, type_)
        except UnicodeEncodeError:
            return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], type_)

    return pa.RecordBatch.from_arrays([array(c, t) for c, t in COLUMNS.items()], names=list(COLUMNS))


def table_of(rows: list[tuple], columns: list[str], kind: str | None = None) -> pa.RecordBatch:
    given = dict(zip(columns, zip(*rows)))
    if kind:
        given["kind"] = [kind] * len(rows)
    return batch_of(given, len(rows))


def kernels() -> dict[str, Callable[[str, bytes, Batches], Iterator[pa.RecordBatch]]]:
    return {"pdf": pdf_rows, "zip": package_rows}


def inspected(files: DataFrame, needed_only: bool = False) -> DataFrame:
    """The rows of all ``described`` files; with ``needed_only`` of texts and rectangles those that a rule can name."""
    def run(batches):
        known, out = kernels(), Batches(needed_only)
        for batch in batches:
            for i in range(batch.num_rows):
                about = tuple(batch.column(c)[i].as_py() for c in names(FILE))
                data, file_id, detected = batch.column("content")[i].as_py(), about[0], about[6]
                began, failure = time.perf_counter(), None
                if data is not None and detected in known:
                    try:
                        yield from known[detected](file_id, data, out)
                    except Exception as e:  # noqa: BLE001  one file must never end the scan of the others
                        failure = str(e) or type(e).__name__
                    out.weight += len(data) >> 4  # what was read counts a little, so that rows of many empty files leave too
                out.files.append((*about, failure, round(1000 * (time.perf_counter() - began))))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return files.mapInArrow(run, ", ".join(ALL))


def unfolded(bodies: DataFrame, parts: int, needed_only: bool = False) -> DataFrame:
    """The rows of streams that ``inspected`` left encoded, each stream by itself; ``parts`` tasks share them."""
    def run(batches):
        out = Batches(needed_only)
        for batch in batches:
            for i in range(batch.num_rows):
                file_id, stream, filters, raw = (batch.column(c)[i].as_py() for c in ("file_id", "stream", "key", "raw"))
                try:
                    put_stream(file_id, stream, pdf.decoded(raw, filters.split()), out)
                except Exception as e:  # noqa: BLE001  the file failed, not the scan
                    out.files.append((file_id, *(None,) * (len(names(FILE)) - 1), str(e) or type(e).__name__, 0))
                if out.full():
                    yield from out.take()
        yield from out.take()

    return bodies.select("file_id", "stream", "key", "raw").repartition(parts, "file_id", "stream").mapInArrow(run, ", ".join(ALL))


def parts_for(bodies: DataFrame) -> int:
    """How many tasks share the bodies: 0 if there are none."""
    of = bodies.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    return min(of["n"], -(-of["bytes"] // SPREAD) * 4, 100_000) if of["n"] else 0


def without_failed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of files that did not fail."""
    return rows.join(files.where("failure IS NOT NULL").select("file_id"), "file_id", "left_anti")


def file_rows(rows: DataFrame) -> DataFrame:
    marks = F.from_json("marks", pdf_rules.MARKS)
    return rows.where("kind = 'file'").select(*[c for c in names(FILE) if c != "marks"], *names(OUTCOME), marks.alias("marks"))


def failed_late(files: DataFrame) -> DataFrame:
    """The file rows with failures that came to light after theirs, in rows that have the id and the failure alone."""
    why = files.where("detected IS NULL").groupBy("file_id").agg(F.min("failure").alias("why"))
    return files.where("detected IS NOT NULL").join(why, "file_id", "left").withColumn("failure", F.coalesce("failure", "why")).drop("why")


def package_entries(files: DataFrame) -> DataFrame:
    """ENTRY rows of ``described`` files."""
    return entry_rows(inspected(files.where("detected = 'zip'")))


def entry_rows(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'entry'").select(*names(ENTRY))


def pdf_evidence(files: DataFrame) -> DataFrame:
    """PDF rows of ``described`` files, all texts and rectangles."""
    from .kept import keep

    rows, _ = keep(inspected(files.where("detected = 'pdf'")), "evidence", by="kind")
    bodies = rows.where("kind = 'body'")
    parts = parts_for(bodies)
    return item_rows(rows.unionByName(unfolded(bodies, parts)) if parts else rows)


def item_rows(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("stream", "string", "text", "rect")).select(*names(PDF))
