"""Hilbert-curve sharding: documents are ordered along a curve through their metadata and cut into runs.

Several metadata dimensions are quantised to ``BITS`` bits each; the curve index of a cell is looked up in a table of
``2 ** (BITS * dimensions)`` rows.  The global rank is found without a single-task sort: counts by (cell, slice of a hash of
id and checksum) are summed to offsets, and only a slice is numbered at a time, so a cell that holds a third of all rows is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from edgeloom.functions.hashing import M, h, h_sql
from edgeloom.llm.common import materialise

BITS = 4
#: Slices of each cell at least, and the rows that a slice has on average at most; a task numbers slices, never a whole cell.
SLICES, SLICE_ROWS = 256, 1 << 18
SHARDS = 8
SEED = 29


def curve_index(point: tuple[int, ...], bits: int) -> int:
    """Hilbert index of a point (Skilling's transform, 2004)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | ((v ^ t) >> b & 1)
    return out


def curve_table(dimensions: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(code, index) of every cell; the code is the coordinates' bits one after another."""
    size = 1 << bits
    return [(c, curve_index(tuple(c >> (bits * (dimensions - 1 - d)) & (size - 1) for d in range(dimensions)), bits)) for c in range(size**dimensions)]


def code_of(dimensions: list[Column], bits: int = BITS) -> Column:
    out = F.lit(0)
    for d in dimensions:
        out = out * (1 << bits) + F.greatest(F.lit(0), F.least(F.lit((1 << bits) - 1), d.cast("int")))
    return out.cast("int")


def text_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def metadata_dimensions() -> list[Column]:
    """Size on a log scale, language and source by a checksum; null is a value of its own."""
    label = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("\0")).cast("binary")) % (1 << BITS)
    return [F.floor(F.log2("size") / 1.25), label("lang"), label("source")]


#: Copies of a row that one task writes out again.
COPIES = 1 << 16


def placed(rows: DataFrame, dimensions: list[Column], bits: int = BITS) -> DataFrame:
    """``rows`` (doc_id, text_crc32, ...) with ``curve`` (index) and ``h``: along (curve, h, doc_id, text_crc32) they are in order."""
    table = F.broadcast(rows.sparkSession.createDataFrame(curve_table(len(dimensions), bits), "code int, curve int"))
    rows = rows.withColumn("code", code_of(dimensions, bits)).join(table, "code").drop("code")
    return rows.withColumn("h", h(SEED, F.coalesce("doc_id", F.lit(-1)), "text_crc32"))


def ranked(groups: DataFrame) -> DataFrame:
    """``groups`` (curve, h, doc_id, text_crc32, n) with ``start``, the rank of a group's first row, and ``total``, that of all rows.

    A cell of the curve is cut by ``h`` into slices whose number follows the count, so a cell that holds a third of all rows
    is spread; counts of slices and of cells (a few thousand) give the offsets, and a task numbers the groups of a slice."""
    count = groups.count()
    width = M // max(SLICES, -(-count // SLICE_ROWS)) + 1
    groups = groups.withColumn("slice", F.floor(F.col("h") / width))
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    slices = groups.groupBy("curve", "slice").agg(F.sum("n").alias("of_slice"))
    cells = slices.groupBy("curve").agg(F.sum("of_slice").alias("of_cell"))
    cells = cells.select("curve", before(Window.orderBy("curve"), "of_cell").alias("cell_start"), F.sum("of_cell").over(Window.partitionBy()).alias("total"))
    slices = slices.join(F.broadcast(cells), "curve").select("curve", "slice", "total", (F.col("cell_start") + before(Window.partitionBy("curve").orderBy("slice"), "of_slice")).alias("slice_start"))
    own = Window.partitionBy("curve", "slice").orderBy("h", F.col("doc_id").asc_nulls_first(), "text_crc32")
    rows = groups.withColumn("inside", before(own, "n")).join(slices, ["curve", "slice"])
    return rows.withColumn("start", F.col("slice_start") + F.col("inside")).drop("slice", "inside", "slice_start")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve`` for every document; law ``rows``: the counts of shards
    differ by one at most.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1, its checksum is that of nothing).  Ties along the curve are ordered by
    a hash of id and checksum, the id (null first), and the checksum; exactly repeated rows take neighbouring slots and are
    counted before they move, so they are no hot task.  An empty table gives an empty result.  Columns other than doc_id,
    text, lang and source are not read.
    """
    rows = docs.select("doc_id", text_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source")
    groups = materialise(placed(rows, metadata_dimensions()).groupBy("curve", "h", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n")))
    every = ranked(groups)
    few = every.filter(F.col("n") <= COPIES).withColumn("rank", F.explode(F.expr("sequence(start, start + n - 1)")))
    many = every.filter(F.col("n") > COPIES).withColumn("at", F.explode(F.expr(f"sequence(start, start + n - 1, {COPIES}L)"))).repartition("at")
    many = many.withColumn("rank", F.explode(F.expr(f"sequence(at, least(at + {COPIES - 1}L, start + n - 1))"))).drop("at")
    out = few.unionByName(many).withColumn("shard", F.expr(f"int(rank * {shards} div total)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write every row of ``docs`` once, as ``shard=<n>`` folders whose rows follow the curve, so that scans prune files on every dimension.

    Rows without ``doc_id`` and rows that repeat one are placed like any other.  ``curve`` is added; if ``docs`` has a column
    ``shard`` or ``curve``, that one is kept and the new one's name gets a ``_`` at its end."""
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    shard, curve = free("shard"), free("curve")
    rows = docs.select("doc_id", text_size().alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "lang", "source", F.struct("*").alias("row"))
    rows = placed(rows, metadata_dimensions()).select("curve", "h", "doc_id", "text_crc32", "row")
    key = ["curve", "h", "doc_id", "text_crc32"]
    groups = ranked(materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))))
    groups = groups.select(*[F.col(c).alias(f"__{c}") for c in key], "n", "start", "total")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
    rows = rows.withColumn("uid", F.monotonically_increasing_id()).join(groups, same).drop(*[f"__{c}" for c in key])
    # the place among repeated rows: exact for up to COPIES of them, evenly spread at random for more
    among = F.row_number().over(Window.partitionBy(*key).orderBy("uid")) - 1
    rows = rows.filter("n = 1").withColumn("i", F.lit(0).cast("bigint")).unionByName(rows.filter(f"n BETWEEN 2 AND {COPIES}").withColumn("i", among.cast("bigint"))).unionByName(
        rows.filter(f"n > {COPIES}").withColumn("i", F.pmod(F.xxhash64("uid"), F.col("n"))))
    rows = rows.withColumn("rank", F.col("start") + F.col("i"))
    rows = rows.select("row", "rank", F.col("curve").alias("at"), F.expr(f"int(rank * {shards} div total)").alias("to"))
    rows = rows.repartitionByRange("rank").sortWithinPartitions("to", "rank")
    rows.select("row.*", F.col("at").alias(curve), F.col("to").alias(shard)).write.partitionBy(shard).parquet(path)


def _crc_table() -> list[int]:
    """The usual table of CRC-32, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


_CRC = f"crc_table AS (SELECT {_crc_table()}::UBIGINT[] AS t)"


def _crc_of(name: str, text: str, source: str, keep: str) -> str:
    """Common table expressions that end in ``name`` with ``keep`` and ``crc`` of ``text`` for each row of ``source``."""
    code = lambda x: f"(strpos('0123456789ABCDEF', {x}) - 1)"
    return f"""{name}_c AS (SELECT {keep}, string_split(hex(encode({text})), '') AS ch FROM {source}),
{name}_b AS (SELECT {keep}, list_transform(range(1, len(ch), 2), lambda i: ({code('ch[i]')} * 16 + {code('ch[i + 1]')})::UBIGINT) AS bs FROM {name}_c),
{name} AS (SELECT {keep}, xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc FROM {name}_b, crc_table)"""


ORACLE = f"""
WITH {_CRC},
cells AS (SELECT unnest({[c for c, _ in sorted(curve_table(3))]}) AS code, unnest({[i for _, i in sorted(curve_table(3))]}) AS curve),
names AS (SELECT DISTINCT coalesce(v, chr(0)) AS v FROM (SELECT lang AS v FROM documents UNION SELECT source FROM documents)),
{_crc_of("label", "v", "names", "v")},
ids AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
{_crc_of("doc", "text", "ids", "doc_id, lang, source, size")},
d AS (SELECT doc.doc_id, doc.size, doc.crc, cells.curve, {h_sql(SEED, "coalesce(doc_id, -1)", "doc.crc")} AS h
      FROM doc JOIN label l ON l.v = coalesce(lang, chr(0)) JOIN label s ON s.v = coalesce(source, chr(0))
      JOIN cells ON cells.code = (greatest(0, least(15, floor(log2(size) / 1.25)))::INT * 16 + l.crc % 16) * 16 + s.crc % 16),
r AS (SELECT *, row_number() OVER (ORDER BY curve, h, doc_id NULLS FIRST, crc) - 1 AS rank, count(*) OVER () AS total FROM d),
p AS (SELECT *, (rank * {SHARDS}) // total AS shard FROM r)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard::INT AS shard, (rank - (shard * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, curve::INT AS curve FROM p
"""
