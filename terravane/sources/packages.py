"""Workbooks and zipped text as data sources: a partition for each sheet or archive member, a writer that commits whole files or nothing.

    register(spark)
    spark.read.format("workbook").load(path)       path, sheet, row_number, values, links
    spark.read.format("zipped_lines").load(path)   path, member, line_number, line
    write_packages(df, "workbook", path, book, sheet, order)

A file beyond the limits is refused as a whole, with the reason; nothing is cut off. Archives carry the SHA-256 of each member, which the reader checks.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Limits: bytes of a workbook, unpacked bytes for a packed one, rows of a sheet with its header, characters of a cell; unpacked bytes of an archive's member.
MOST_BYTES, MOST_RATIO, MOST_ROWS, MOST_CELL, MOST_MEMBER = 5 << 20, 100, 1000, 4000, 256 << 20
SUMS = "SHA256SUMS"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"


class Refused(ValueError):
    """A file or a sheet beyond the limits, or one that is not what it says."""


def _store(path: str):
    """(file system, path in it) of a path or an address."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def checked_archive(handle, size: int, most: int = MOST_BYTES) -> zipfile.ZipFile:
    """The archive behind a file, if it is within the limits."""
    if size > most:
        raise Refused("the file is too large")
    try:
        archive = zipfile.ZipFile(handle)
    except zipfile.BadZipFile as e:
        raise Refused("the file is no archive") from e
    if sum(i.file_size for i in archive.infolist()) > MOST_RATIO * max(1, size):
        raise Refused("the file unpacks to too much")
    return archive


# workbooks


def _relations(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    folder, _, file = name.rpartition("/")
    at = f"{folder}/_rels/{file}.rels"
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read(at))} if at in archive.namelist() else {}


def sheets_of(archive: zipfile.ZipFile) -> dict[str, str]:
    """Sheet names, in the order of the workbook, with their members; a workbook without a list has the names of its members."""
    if "xl/workbook.xml" not in archive.namelist():
        return {n.rpartition("/")[2][:-4]: n for n in archive.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)}
    targets = _relations(archive, "xl/workbook.xml")
    book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
    found = {s.get("name"): targets.get(s.get(f"{{{_LINKS}}}id"), "") for s in book.iter(f"{{{_MAIN}}}sheet")}
    return {k: v.lstrip("/") if v.startswith("/") else f"xl/{v}" for k, v in found.items()}


def sheet_rows(archive: zipfile.ZipFile, member: str) -> list[tuple[int, dict[str, str], dict[str, str]]]:
    """(row number, {header: text}, {header: address}) of a sheet, headers from its first filled row; refused if it has more rows than the limit."""
    tag = lambda n: f"{{{_MAIN}}}{n}"
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in si.iter(tag("t"))) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(tag("si"))]
    root = ElementTree.fromstring(archive.read(member))
    targets = _relations(archive, member)
    at = {h.get("ref"): targets.get(h.get(f"{{{_LINKS}}}id")) for h in root.iter(tag("hyperlink"))}
    rows = []
    for row in root.iter(tag("row")):
        cells, links = {}, {}
        for c in row.findall(tag("c")):
            v, kind, place = c.find(tag("v")), c.get("t"), c.get("r")
            text = shared[int(v.text)] if kind == "s" and v is not None else "".join(t.text or "" for t in c.iter(tag("t"))) if kind == "inlineStr" else (v.text if v is not None else "")
            column = re.match("[A-Z]+", place)[0]
            cells[column] = (text or "").strip()
            if at.get(place):
                links[column] = at[place]
        if any(cells.values()):
            rows.append((int(row.get("r")), cells, links))
            if len(rows) > MOST_ROWS:
                raise Refused(f"the sheet has more than {MOST_ROWS} rows")
    header = rows[0][1] if rows else {}
    named = lambda cells: {header[k]: v for k, v in cells.items() if header.get(k)}
    return [(n, named(cells), named(links)) for n, cells, links in rows[1:]]


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def workbook(sheets: dict[str, list[Sequence[str | None]]], header: Sequence[str]) -> bytes:
    """An XLSX file of sheets of text cells; a cell that is an address becomes a link."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = [f"xl/worksheets/sheet{i}.xml" for i in range(1, len(sheets) + 1)]
        kinds = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for n in names)
        z.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_LINKS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name={quoteattr(s)} sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets>{listed}</sheets></workbook>')
        targets = "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{targets}</Relationships>')
        for name, rows in zip(names, sheets.values()):
            if len(rows) + 1 > MOST_ROWS:
                raise Refused(f"a sheet of {len(rows) + 1} rows is beyond the limit of {MOST_ROWS}")
            lines, links = [], []
            for n, row in enumerate([header, *rows], 1):
                cells = []
                for k, value in enumerate(row):
                    if value is None or value == "":
                        continue
                    if len(value) > MOST_CELL:
                        raise Refused(f"a cell of {len(value)} characters is beyond the limit of {MOST_CELL}")
                    cells.append(f'<c r="{_letters(k)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(_printable(value))}</t></is></c>')
                    if n > 1 and re.match("https?://", value):
                        links.append((f"{_letters(k)}{n}", value))
                lines.append(f'<row r="{n}">{"".join(cells)}</row>')
            refs = "".join(f'<hyperlink ref="{r}" r:id="rId{i}"/>' for i, (r, _) in enumerate(links, 1))
            z.writestr(name, f'<worksheet xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheetData>{"".join(lines)}</sheetData>{f"<hyperlinks>{refs}</hyperlinks>" if refs else ""}</worksheet>')
            if links:
                targets = "".join(f'<Relationship Id="rId{i}" Type="{_LINKS}/hyperlink" Target={quoteattr(u)} TargetMode="External"/>' for i, (_, u) in enumerate(links, 1))
                z.writestr(f"xl/worksheets/_rels/{name.rpartition('/')[2]}.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">{targets}</Relationships>')
    if out.tell() > MOST_BYTES:
        raise Refused("the workbook is too large")
    return out.getvalue()


def _printable(value: str) -> str:
    """The text without characters that a workbook cannot hold."""
    return re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", value)


def archive_of(members: dict[str, list[Sequence[str | None]]], header: Sequence[str]) -> bytes:
    """A ZIP file of members of lines, values joined by "|", and the SHA-256 of each member."""
    out, sums = io.BytesIO(), []
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, rows in members.items():
            if any(re.search(r"[|\r\n]", v) for r in rows for v in r if v is not None):
                raise Refused("a value holds a separator")
            data = "".join("|".join(v or "" for v in r) + "\n" for r in [header, *rows]).encode()
            z.writestr(name, data)
            sums.append(f"{hashlib.sha256(data).hexdigest()}  {name}\n")
        z.writestr(SUMS, "".join(sums))
    return out.getvalue()


# data sources


class Part(InputPartition):
    def __init__(self, path: str, member: str, name: str):
        super().__init__((path, member, name))
        self.path, self.member, self.name = path, member, name


class _Reader(DataSourceReader):
    ending, most = "", MOST_BYTES

    def __init__(self, options):
        self.path = options["path"]

    def _open(self, store, path: str):
        handle = store.open_input_file(path)
        return handle, checked_archive(handle, handle.size(), self.most)

    def files(self, store, root: str) -> list[str]:
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [root]
        return sorted(i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and i.path.endswith(self.ending) and "/_" not in i.path[len(root) :])

    def partitions(self) -> list[Part]:
        store, root = _store(self.path)
        found = []
        for path in self.files(store, root):
            handle, archive = self._open(store, path)
            with handle, archive:
                found += [Part(path, member, name) for name, member in self.members(archive).items()]
        return found

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _store(self.path)
        handle, archive = self._open(store, partition.path)
        with handle, archive:
            yield from self.rows(archive, partition)


class _SheetReader(_Reader):
    ending = ".xlsx"

    def members(self, archive):
        return sheets_of(archive)

    def rows(self, archive, part):
        for n, values, links in sheet_rows(archive, part.member):
            yield part.path, part.name, n, values, links


class _LineReader(_Reader):
    ending, most = ".zip", 1 << 40

    def members(self, archive):
        return {i.filename: i.filename for i in archive.infolist() if i.filename != SUMS and not i.is_dir()}

    def rows(self, archive, part):
        if archive.getinfo(part.member).file_size > MOST_MEMBER:
            raise Refused(f"{part.member} is too large")
        data = archive.read(part.member)
        if SUMS in archive.namelist():
            told = dict(reversed(line.split("  ", 1)) for line in archive.read(SUMS).decode().splitlines())
            if told.get(part.member) != hashlib.sha256(data).hexdigest():
                raise Refused(f"{part.member} is not what its checksum says")
        for n, line in enumerate(data.decode("utf-8-sig").splitlines(), 1):
            yield part.path, part.member, n, line


class Written(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class _Writer(DataSourceWriter):
    """Files of a task under a name of the attempt; they get their own names when the job commits, and go when it aborts."""

    def __init__(self, options, schema, ending, encode):
        self.path, self.ending, self.encode = options["path"], ending, encode
        self.header = [f.name for f in schema.fields[2:]]
        self.job = uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        store, root = _store(self.path)
        waiting = f"{root}/_waiting-{self.job}/{uuid.uuid4().hex}"
        names: list[str] = []

        def close():
            if book is not None:
                store.create_dir(waiting, recursive=True)
                with store.open_output_stream(f"{waiting}/{book}{self.ending}") as f:
                    f.write(self.encode(sheets, self.header))
                names.append(f"{waiting}/{book}{self.ending}")

        book, sheets = None, {}
        for row in rows:  # the rows of a file come together, see write_packages()
            if row[0] != book:
                close()
                book, sheets = row[0], {}
            sheets.setdefault(row[1], []).append([None if v is None else str(v) for v in row[2:]])
            if self.ending == ".xlsx" and len(sheets[row[1]]) + 1 > MOST_ROWS:
                raise Refused(f"sheet {row[1]} of {book} has more than {MOST_ROWS} rows")
        close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        for name in (n for m in messages if m for n in m.names):
            store.move(name, f"{root}/{name.rpartition('/')[2]}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_waiting-{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_waiting-{self.job}")


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, row_number bigint, values map<string,string>, links map<string,string>"

    def reader(self, schema) -> DataSourceReader:
        return _SheetReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, ".xlsx", workbook)


class ZippedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_lines"

    def schema(self) -> str:
        return "path string, member string, line_number bigint, line string"

    def reader(self, schema) -> DataSourceReader:
        return _LineReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema, ".zip", archive_of)


def register(spark: SparkSession) -> None:
    for source in (Workbook, ZippedLines):
        spark.dataSource.register(source)


def write_packages(df: DataFrame, form: str, path: str, book: str, sheet: str, order: Sequence[Column | str]) -> None:
    """df as files, one for each value of book, with a sheet or member for each value of sheet, rows in order; the other columns are written as text.

    Files are dealt out by name, so each is made in one task; a job that fails leaves nothing behind.
    """
    register(df.sparkSession)
    own = [book, sheet, *[c for c in df.columns if c not in (book, sheet)]]
    df.repartition(book).sortWithinPartitions(book, sheet, *order).select(*own).write.format(form).mode("append").save(path)
