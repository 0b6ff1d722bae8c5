"""Family trees in SQLite files as DataFrames: a read-only data source, schema discovery and the mapping of tables."""

from __future__ import annotations

import hashlib
import re
import shutil
import sqlite3
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names under which the tables and columns of a tree go.
TABLES = {
    "person": ("PersonTable", "People", "Person"), "name": ("NameTable", "Names", "Name"), "family": ("FamilyTable", "Families", "Family"), "child": ("ChildTable", "Children", "Child"),
    "place": ("PlaceTable", "Places", "Place"), "event": ("EventTable", "Events", "Event"), "fact_type": ("FactTypeTable", "FactTypes"), "note": ("NoteTable", "Notes"),
    "source": ("SourceTable", "Sources"), "citation": ("CitationTable", "Citations"), "media": ("MultimediaTable", "MediaTable", "Media"),
}
COLUMNS = {
    "person": {"id": ("personid", "id"), "sex": ("sex", "gender"), "living": ("living", "isliving")},
    "name": {"id": ("nameid",), "owner": ("ownerid", "personid"), "given": ("given", "givenname"), "surname": ("surname", "lastname"), "primary": ("isprimary", "primaryname")},
    "family": {"id": ("familyid", "id"), "father": ("fatherid", "husbandid"), "mother": ("motherid", "wifeid")},
    "child": {"family": ("familyid",), "child": ("childid", "personid")},
    "place": {"id": ("placeid", "id"), "name": ("name", "placename")},
    "event": {"id": ("eventid",), "owner": ("ownerid", "personid"), "family": ("familyid",), "type": ("eventtype", "eventtypeid", "typeid", "type"), "date": ("date", "eventdate"), "place": ("placeid",), "place_name": ("place",), "detail": ("details", "detail", "description", "note")},
    "fact_type": {"id": ("facttypeid", "eventtypeid", "typeid"), "name": ("name",), "tag": ("gedcomtag",)},
    "citation": {"id": ("citationid",), "source": ("sourceid",), "owner": ("ownerid", "personid"), "family": ("familyid",)},
    "source": {"id": ("sourceid", "id"), "text": ("text", "name", "title")},
    "note": {"id": ("noteid",), "owner": ("ownerid", "personid"), "family": ("familyid",), "text": ("text", "note")},
    "media": {"id": ("mediaid",), "owner": ("ownerid", "personid"), "family": ("familyid",), "file": ("mediafile", "file", "path")},
}
FACT_TAGS = {"birth": "BIRT", "death": "DEAT", "marriage": "MARR", "burial": "BURI", "christen": "CHR", "baptism": "BAPM", "occupation": "OCCU", "residence": "RESI", "divorce": "DIV"}
MAX_ROWS, ROWS_PER_PARTITION, MAX_BYTES, MAX_ROW_BYTES = 5_000_000, 200_000, 8 * 1024**3, 16 * 1024**2


def list_trees(roots: list[str]) -> list[str]:
    """The .rmtree files below the allowed folders, sorted."""
    return sorted(str(p) for r in roots for p in Path(r).glob("*.rmtree") if p.is_file())


def resolve_tree(name: str, roots: list[str]) -> str:
    """The path of a tree by name or absolute path; only inside the allowed folders, and only .rmtree files."""
    for r in roots:
        root = Path(r).resolve()
        p = (Path(name) if Path(name).is_absolute() else root / name).resolve()
        if p.suffix == ".rmtree" and p.is_file() and p.is_relative_to(root):
            return str(p)
    raise FileNotFoundError(name)


def open_read_only(path: str) -> sqlite3.Connection:
    """An immutable connection that can run nothing but SELECT."""
    c = sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True)
    c.execute("pragma query_only = on")
    allowed = {sqlite3.SQLITE_SELECT, sqlite3.SQLITE_READ, sqlite3.SQLITE_FUNCTION}
    c.set_authorizer(lambda action, *a: sqlite3.SQLITE_OK if action in allowed and not (action == sqlite3.SQLITE_FUNCTION and a[1] == "load_extension") else sqlite3.SQLITE_DENY)
    return c


def _digest(path: str) -> str:
    """The hash of a file and of the log beside it, a piece at a time."""
    h = hashlib.sha256()
    for p in (Path(path), Path(f"{path}-wal")):
        if p.exists():
            h.update(p.name[-4:].encode())
            with p.open("rb") as f:
                while piece := f.read(1 << 20):
                    h.update(piece)
    return h.hexdigest()


def snapshot(path: str, folder: str | None = None) -> str:
    """A copy to read from, verified not to have changed meanwhile, its log included.

    The folder must be one that all executors share; only in a local session one of this machine is made where none is given.
    """
    if folder is None:
        session = SparkSession.getActiveSession()
        if session is not None and not session.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster the copy needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="stemma-tree-")
    if Path(path).stat().st_size > MAX_BYTES:
        raise ValueError(f"the tree has more than {MAX_BYTES} bytes")
    before = _digest(path)
    copy = f"{folder}/{before[:20]}.rmtree"
    shutil.copyfile(path, copy)
    if Path(f"{path}-wal").exists():
        shutil.copyfile(f"{path}-wal", f"{copy}-wal")
        c = sqlite3.connect(copy)
        c.execute("pragma wal_checkpoint(truncate)")
        c.execute("pragma journal_mode = delete")
        c.close()
    if _digest(path) != before:
        raise OSError("the tree changed while it was read")
    return copy


def check_rows(path: str, most: int | None = None) -> int:
    """The number of rows of all tables; more than MAX_ROWS are an error before anything is read."""
    most = MAX_ROWS if most is None else most
    with open_read_only(path) as c:
        n = sum(c.execute(f'select count(*) from "{t}"').fetchone()[0] for t in table_columns(path))
    if n > most:
        raise ValueError(f"the tree has {n} rows, {most} are allowed")
    return n


def table_columns(path: str) -> dict[str, list[tuple[str, str]]]:
    """Tables with their columns and declared types, read from the texts that created them."""
    out = {}
    with open_read_only(path) as c:
        for name, sql in c.execute("select name, sql from sqlite_master where type = 'table' and sql is not null order by name").fetchall():
            body = sql[sql.index("(") + 1 : sql.rindex(")")]
            columns = []
            for part in _split_top(body):
                m = re.match(r"""\s*(?:"([^"]+)"|\[([^\]]+)\]|`([^`]+)`|(\w+))\s*([A-Za-z]*)""", part)
                if m and (m[4] or "").upper() not in ("PRIMARY", "UNIQUE", "CHECK", "FOREIGN", "CONSTRAINT"):
                    columns.append((next(g for g in m.groups()[:4] if g), m[5].upper()))
            out[name] = columns
    return out


def _split_top(body: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(body[at:i])
            at = i + 1
    return [*parts, body[at:]]


def spark_type(declared: str) -> T.DataType:
    """Integers, reals and blobs as such; everything else is text, as SQLite puts any value anywhere."""
    if "INT" in declared:
        return T.LongType()
    if "BLOB" in declared:
        return T.BinaryType()
    return T.DoubleType() if declared in ("REAL", "FLOAT", "DOUBLE") else T.StringType()


def _cell(value: object, kind: T.DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, T.BinaryType):
        return value if isinstance(value, bytes) else str(value).encode()
    if isinstance(kind, T.LongType):
        return value if isinstance(value, int) else (int(value) if isinstance(value, (str, float)) and re.fullmatch(r"[+-]?\d+(\.0)?", str(value)) else None)
    if isinstance(kind, T.DoubleType):
        try:
            return float(value)
        except (TypeError, ValueError):
            return None
    return value.hex() if isinstance(value, bytes) else str(value)


class Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None) -> None:
        self.low, self.high = low, high


class TreeReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType, rows: int) -> None:
        self.path, self.table, self.kinds, self.rows = path, table, schema, rows

    def partitions(self) -> list[Rows]:
        """Ranges of row ids with equal numbers of rows, so that large tables are read by several tasks; a table without row ids is read by one."""
        with open_read_only(self.path) as c:
            try:
                starts = [r[0] for r in c.execute(f'select rowid from (select rowid, row_number() over (order by rowid) n from "{self.table}") where n % ? = 1 order by 1', (self.rows,))]
            except sqlite3.OperationalError:
                return [Rows(None, None)]
        if not starts:
            return [Rows(0, 0)]
        return [Rows(a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition: Rows) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.kinds.fields)
        bounds = [(op, v) for op, v in ((">=", partition.low), ("<", partition.high)) if v is not None]
        where = " and ".join(f"rowid {op} ?" for op, _ in bounds)
        with open_read_only(self.path) as c:
            c.text_factory = lambda b: b.decode("utf-8", "replace")
            for row in c.execute(f'select {columns} from "{self.table}"' + (f" where {where}" if where else ""), [v for _, v in bounds]):
                if sum(len(v) for v in row if isinstance(v, (str, bytes))) > MAX_ROW_BYTES:
                    raise ValueError(f"a row of {self.table} has more than {MAX_ROW_BYTES} bytes")
                yield tuple(_cell(v, f.dataType) for v, f in zip(row, self.kinds.fields, strict=True))


class SqliteTree(DataSource):
    """format("sqlite_tree").option("path", ...).option("table", ...): one table of a SQLite file, read only."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_tree"

    def schema(self) -> T.StructType:
        columns = {k.lower(): v for k, v in table_columns(self.options["path"]).items()}[self.options["table"].lower()]
        return T.StructType([T.StructField(n, spark_type(d)) for n, d in columns])

    def reader(self, schema: T.StructType) -> TreeReader:
        return TreeReader(self.options["path"], self.options["table"], schema, int(self.options.get("rowsPerPartition", ROWS_PER_PARTITION)))


def read_table(spark: SparkSession, path: str, table: str, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame | None:
    """A table of the tree, or None if there is no such table."""
    if table.lower() not in {t.lower() for t in table_columns(path)}:
        return None
    spark.dataSource.register(SqliteTree)
    return spark.read.format("sqlite_tree").option("path", path).option("table", table).option("rowsPerPartition", rows_per_partition).load()


def logical_tables(path: str) -> dict[str, str]:
    """The actual name of each logical table that the file has."""
    have = {t.lower(): t for t in table_columns(path)}
    found = ((k, next((have[a.lower()] for a in names if a.lower() in have), None)) for k, names in TABLES.items())
    return {k: t for k, t in found if t}


def alias(df: DataFrame, names: tuple[str, ...]) -> Column:
    """The first of the named columns that exists and is filled, as text."""
    have = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{have[n]}`").cast("string") for n in names if n in have]
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in found)) if found else F.lit(None).cast("string")


def logical(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """A logical table with the usual names of its columns; ids of 0 and `none` are null."""
    actual = logical_tables(path).get(kind)
    if actual is None:
        return None
    df = read_table(spark, path, actual)
    ids = ("id", "owner", "father", "mother", "family", "child", "source", "place")
    cols = []
    for n, names in COLUMNS[kind].items():
        c = alias(df, names)
        cols.append((F.when(~F.lower(c).isin("0", "none"), c) if n in ids else c).alias(n))
    return df.select(*cols)


def people(spark: SparkSession, path: str, living: str = "exclude") -> DataFrame:
    """(id, given, surname, gender, living, redacted): persons under the living policy: exclude, redact or include."""
    if living not in ("exclude", "redact", "include"):
        raise ValueError(living)
    p, n = logical(spark, path, "person"), logical(spark, path, "name")
    truthy = lambda c: F.lower(F.coalesce(c, F.lit(""))).isin("1", "true", "yes")
    gender = F.when(F.lower("sex").isin("0", "m", "male"), "M").when(F.lower("sex").isin("1", "f", "female"), "F").otherwise("U")
    out = p.where("id is not null").select("id", gender.alias("gender"), truthy(F.col("living")).alias("living"))
    if n is not None:
        order = F.struct(truthy(F.col("primary")).cast("int").alias("p"), (-F.coalesce(F.col("id").cast("long"), F.lit(0))).alias("i"))
        best = n.where("owner is not null").groupBy(F.col("owner").alias("o")).agg(F.max_by(F.struct("given", "surname"), order).alias("n"))
        out = out.join(best, F.col("id") == F.col("o"), "left").select("id", "n.given", "n.surname", "gender", "living")
    else:
        out = out.select("id", F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("surname"), "gender", "living")
    if living == "exclude":
        out = out.where("not living")
    hide = F.col("living") & F.lit(living == "redact")
    return out.select("id", F.when(hide, "Living").otherwise(F.col("given")).alias("given"), F.when(hide, "").otherwise(F.col("surname")).alias("surname"), F.when(hide, "U").otherwise(F.col("gender")).alias("gender"), "living", hide.alias("redacted"))


def scope(spark: SparkSession, path: str, root: str, kind: str, generations: int | None = None) -> DataFrame:
    """(node, depth): persons within so many generations of the root: ancestors, descendants or connected."""
    from stemma.operators.graph import reach

    f, c = logical(spark, path, "family"), logical(spark, path, "child")
    parents = f.select(F.col("id").alias("fam"), F.explode(F.array("father", "mother")).alias("parent")).where("parent is not null")
    pc = parents.join(c.select(F.col("family").alias("fam"), "child"), "fam").where("child is not null").select("parent", "child").distinct()
    up, down = pc.select(F.col("child").alias("src"), F.col("parent").alias("dst")), pc.select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    pair = parents.join(parents.select("fam", F.col("parent").alias("dst")), "fam").where("parent != dst").select(F.col("parent").alias("src"), "dst")
    edges = {"ancestors": up, "descendants": down, "connected": up.unionAll(down).unionAll(pair)}[kind]
    return reach(edges, spark.createDataFrame([(root,)], "node string"), generations)


def events(spark: SparkSession, path: str) -> DataFrame:
    """(id, owner_kind, owner, tag, type_name, date, place, detail): a person owns before a family does; types become tags."""
    e = logical(spark, path, "event")
    ft, pl = logical(spark, path, "fact_type"), logical(spark, path, "place")
    if ft is not None:
        e = e.join(ft.select(F.col("id").alias("type"), F.col("name").alias("type_name"), F.col("tag").alias("gedcom_tag")).dropDuplicates(["type"]), "type", "left")
    else:
        e = e.withColumn("type_name", F.col("type")).withColumn("gedcom_tag", F.lit(None).cast("string"))
    if pl is not None:
        e = e.join(pl.groupBy(F.col("id").alias("place")).agg(F.min("name").alias("of_id")), "place", "left")
    else:
        e = e.withColumn("of_id", F.lit(None).cast("string"))
    by_name = F.lit(None).cast("string")
    for n, t in FACT_TAGS.items():
        by_name = F.when(F.lower("type_name") == n, t).otherwise(by_name)
    tag = F.coalesce(F.when(F.col("gedcom_tag").rlike("^[A-Z_]{3,5}$"), F.col("gedcom_tag")), by_name, F.lit("EVEN"))
    return e.select(
        "id", F.when(F.col("owner").isNotNull(), "person").when(F.col("family").isNotNull(), "family").alias("owner_kind"), F.coalesce("owner", "family").alias("owner"), tag.alias("tag"), "type_name", "date",
        F.coalesce("of_id", "place_name").alias("place"), "detail",
    )


def publishable_sources(spark: SparkSession, path: str, safe: DataFrame) -> DataFrame:
    """Ids of sources that a citation of a safe owner (id) names, and no citation of another."""
    from stemma.operators.relations import safe_only

    c = logical(spark, path, "citation")
    uses = c.join(safe.select(F.col("id").alias("owner"), F.lit(True).alias("ok")).distinct(), "owner", "left").select(F.col("source").alias("id"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return safe_only(logical(spark, path, "source").select("id"), uses, "id", F.col("ok"))


def in_scope(spark: SparkSession, path: str, living: str = "exclude", root: str | None = None, kind: str = "connected", generations: int | None = None) -> DataFrame:
    """The persons that are exported: those of the living policy, in the scope of the root if there is one."""
    p = people(spark, path, living)
    return p if root is None else p.join(scope(spark, path, root, kind, generations).select(F.col("node").alias("id")), "id", "left_semi")


def unmapped(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """(id, tag, value): filled columns of a logical table that nothing maps, under the tags that keep them; bytes are left out."""
    from stemma.functions.normal import retained_tag
    from stemma.operators.relations import unpivot_rest

    actual = logical_tables(path).get(kind)
    if actual is None:
        return None
    df = read_table(spark, path, actual)
    used = {n for names in COLUMNS[kind].values() for n in names}
    key = next((c for c in df.columns if c.lower() in COLUMNS[kind]["id"]), None)
    rest = [f.name for f in df.schema.fields if f.name.lower() not in used and not isinstance(f.dataType, T.BinaryType)]
    if key is None or not rest:
        return None
    slim = df.select(F.col(f"`{key}`").cast("string").alias("id"), *(F.col(f"`{c}`") for c in rest if c != "id"))
    return unpivot_rest(slim, "id", []).select("id", retained_tag(F.col("field")).alias("tag"), F.regexp_replace("value", r"[\r\n]+", " ").alias("value"))


def _attached(spark: SparkSession, path: str, kind: str, owners: DataFrame) -> DataFrame | None:
    """Rows of notes, citations or media whose owner is exported, in the order of their ids."""
    rows = logical(spark, path, kind)
    return None if rows is None else rows.where("owner is not null").join(owners.select(F.col("id").alias("owner")), "owner", "left_semi")


def export_lines(spark: SparkSession, path: str, living: str = "exclude", root: str | None = None, kind: str = "connected", generations: int | None = None) -> DataFrame:
    """(source, ord, rec, pos, level, xref, tag, value): a tree as GEDCOM lines, ready for the writer.

    People, families and sources are numbered in the order of their ids. Families keep members that are exported only. People bring
    their events, notes, citations of sources that only safe owners cite, media, and the columns that nothing maps; those who are
    redacted bring none.
    """
    from stemma.operators.relations import ranked, semantic_key

    no = F.lit("")
    typed = "array<struct<level: int, xref: string, tag: string, value: string>>"
    line = lambda level, xr, tag, value: F.struct(F.lit(level).alias("level"), xr.alias("xref"), (tag if isinstance(tag, Column) else F.lit(tag)).alias("tag"), F.coalesce(value, no).alias("value"))
    p = ranked(in_scope(spark, path, living, root, kind, generations), [semantic_key(F.col("id"))], "n")
    f = ranked(logical(spark, path, "family").where("id is not null"), [semantic_key(F.col("id"))], "n")
    xref = p.select("id", F.concat(F.lit("@I"), "n", F.lit("@")).alias("x"))
    safe = p.where("not redacted").select("id")
    # (id, part, key, lines): what each person brings, in the order of part and key
    name = F.concat(F.coalesce("given", no), F.lit(" /"), F.coalesce("surname", no), F.lit("/"))
    parts = [p.select("id", F.lit(0).alias("part"), F.lit("").alias("key"), F.array(line(0, F.concat(F.lit("@I"), "n", F.lit("@")), "INDI", no), line(1, no, "NAME", name), line(1, no, "SEX", F.col("gender"))).cast(typed).alias("lines"))]

    def bring(df: DataFrame | None, part: int, owner: str, key: str, *rows: Column) -> None:
        if df is not None:
            given = F.filter(F.array(*rows).cast(typed), lambda x: (x["level"] == 1) | (x["value"] != ""))
            parts.append(df.select(F.col(owner).alias("id"), F.lit(part).alias("part"), F.col(key).alias("key"), given.alias("lines")).join(safe, "id", "left_semi"))

    if logical(spark, path, "event") is not None:
        bring(events(spark, path).where("owner_kind = 'person'").withColumnRenamed("id", "e"), 1, "owner", "e", line(1, no, F.col("tag"), F.col("detail")), line(2, no, "DATE", F.col("date")), line(2, no, "PLAC", F.col("place")))
    bring(_attached(spark, path, "note", safe), 2, "owner", "id", line(1, no, "NOTE", F.col("text")))
    sources = None
    if logical(spark, path, "citation") is not None and logical(spark, path, "source") is not None:
        ids = publishable_sources(spark, path, safe).distinct()
        sources = ranked(logical(spark, path, "source").join(ids, "id", "left_semi"), [semantic_key(F.col("id"))], "n")
        cites = _attached(spark, path, "citation", safe).join(sources.select(F.col("id").alias("source"), F.concat(F.lit("@S"), "n", F.lit("@")).alias("sx")), "source")
        bring(cites, 3, "owner", "id", line(1, no, "SOUR", F.col("sx")))
    bring(_attached(spark, path, "media", safe), 4, "owner", "id", line(1, no, "OBJE", no), line(2, no, "FILE", F.col("file")))
    bring(unmapped(spark, path, "person"), 5, "id", "tag", line(1, no, F.col("tag"), F.col("value")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    whole = every.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", semantic_key(F.col("key")).alias("k"), "lines"))), lambda x: x["lines"])).alias("lines"))
    person_lines = whole.join(p.select("id", "n"), "id").select(F.col("n").alias("rec"), F.posexplode("lines").alias("pos", "l"))
    member = lambda col, tag: f.select("n", F.col(col).alias("id")).join(xref, "id").select("n", F.lit(tag).alias("tag"), "x")
    ch = logical(spark, path, "child").join(f.select(F.col("id").alias("family"), "n"), "family").select("n", F.col("child").alias("id")).join(xref, "id").select("n", F.lit("CHIL").alias("tag"), "x")
    members = member("father", "HUSB").unionAll(member("mother", "WIFE")).unionAll(ch).groupBy("n").agg(F.array_sort(F.collect_set(F.struct(F.when(F.col("tag") == "HUSB", 0).when(F.col("tag") == "WIFE", 1).otherwise(2).alias("o"), "x", "tag"))).alias("ms"))
    base = p.agg(F.coalesce(F.max("n"), F.lit(0)).alias("people"))
    # one row
    fam_lines = members.join(F.broadcast(base), F.lit(True)).select(
        (F.col("n") + F.col("people")).alias("rec"),
        F.posexplode(F.concat(F.array(line(0, F.concat(F.lit("@F"), "n", F.lit("@")), "FAM", no)), F.transform("ms", lambda m: F.struct(F.lit(1).alias("level"), no.alias("xref"), m["tag"].alias("tag"), m["x"].alias("value")))).cast(typed)).alias("pos", "l"),
    )
    out = person_lines.unionAll(fam_lines)
    if sources is not None:
        top = f.agg(F.coalesce(F.max("n"), F.lit(0)).alias("families"))
        out = out.unionAll(sources.join(F.broadcast(base), F.lit(True)).join(F.broadcast(top), F.lit(True)).select((F.col("n") + F.col("people") + F.col("families")).alias("rec"), F.posexplode(F.array(line(0, F.concat(F.lit("@S"), "n", F.lit("@")), "SOUR", no), line(1, no, "TITL", F.col("text"))).cast(typed)).alias("pos", "l")))
    return out.select(F.lit("tree").alias("source"), F.lit(1).alias("ord"), F.col("rec").cast("long").alias("rec"), "pos", "l.level", "l.xref", "l.tag", "l.value")


def export_losses(spark: SparkSession, path: str, lines: DataFrame, living: str = "exclude", root: str | None = None, kind: str = "connected", generations: int | None = None) -> DataFrame:
    """(table_name, n_rows, lost): rows of each table of the tree that have no line in an export; only tables that lose any."""
    from stemma.operators.relations import losses

    have = logical_tables(path)
    heads = lambda tag: lines.where((F.col("level") == 0) & (F.col("tag") == tag))
    tops = lambda *tags: lines.where((F.col("level") == 1) & F.col("tag").isin(*tags))
    safe = in_scope(spark, path, living, root, kind, generations).where("not redacted").select("id")
    written = {"person": heads("INDI"), "family": heads("FAM"), "child": tops("CHIL"), "source": heads("SOUR"), "citation": tops("SOUR"), "note": tops("NOTE"), "media": tops("OBJE")}
    if "name" in have:
        written["name"] = in_scope(spark, path, living, root, kind, generations).where("not redacted and (given is not null or surname is not null)")
    if "event" in have:
        written["event"] = events(spark, path).where("owner_kind = 'person'").select(F.col("owner").alias("id")).join(safe, "id", "left_semi")
    return losses([(have[k], read_table(spark, path, have[k]), w) for k, w in written.items() if k in have])
