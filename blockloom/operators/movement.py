"""Moving page payloads into blocks and back.

Keys are joined first and payloads last, so payload columns cross a shuffle
once, and only for blocks that move.  A block meets its pages by stretches of the
page table: it is sent once for each stretch it touches, not once for each page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockloom.sources.shared import written


def out_of_range(blocks: DataFrame, num_pages: int) -> DataFrame:
    """``blocks`` and ``reject_code``: 'page_range' if a page index lies outside the page table."""
    bad = F.exists("pages", lambda p: (p < 0) | (p >= num_pages))
    return blocks.withColumn("reject_code", F.when(bad, F.lit("page_range")))


#: Bits of a page's place in its stretch, 1024 pages.
BITS = 10


def parts(blocks: DataFrame, bits: int = BITS) -> DataFrame:
    """Blocks (block_key, pages) cut by stretch: (block_key, stretch, poss, idx), positions in the block and their pages."""

    def part(stretch: Column) -> Column:
        poss = F.filter(F.sequence(F.lit(0), F.size("pages") - 1), lambda i: F.shiftright(F.get("pages", i), bits) == stretch)
        return F.struct(stretch.cast("bigint").alias("stretch"), poss.alias("poss"), F.filter("pages", lambda p: F.shiftright(p, bits) == stretch).alias("idx"))

    found = F.array_distinct(F.transform("pages", lambda p: F.shiftright(p, bits)))
    return blocks.select("block_key", F.explode(F.transform(found, part)).alias("part")).select("block_key", "part.*")


def _place(bits: int) -> Column:
    return F.col("page_idx").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def stretches(pages: DataFrame, bits: int = BITS) -> DataFrame:
    """Pages (page_idx, payload) as a row for each stretch: (stretch, held), the list of payloads of every place up to the last that has one, null at places without a page."""
    each = pages.where("page_idx is not null").groupBy("page_idx").agg(F.collect_list(F.struct("payload")).alias("list"))
    rows = each.groupBy(F.shiftright("page_idx", bits).cast("bigint").alias("stretch")).agg(F.sort_array(F.collect_list(F.struct(_place(bits).alias("place"), "list"))).alias("known"))
    at = lambda i: F.get("known", i)["place"]
    none = F.lit(None).cast(each.schema["list"].dataType)
    held = F.transform(F.sequence(F.lit(0), F.size("known") - 1), lambda i: F.concat(F.array_repeat(none, at(i) - F.coalesce(at(i - 1), F.lit(-1)) - 1), F.array(F.get("known", i)["list"])))
    return rows.select("stretch", F.flatten(held).alias("held"))


def gather(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """(block_key, pos, payload) of each block (block_key, pages) in the order of its page indices.

    Rows come out by stretch, so that a file of them repeats few payloads often.
    The page table is dense, and a stretch of its payloads is one row: it is
    meant for payloads of up to some KB.
    """
    return gathered(blocks, pages).select("block_key", "pos", "payload")


def gathered(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """``gather`` with each row's ``stretch`` and ``copies``, how many payloads its page has."""
    met = parts(blocks).join(stretches(pages).hint("shuffle_hash"), "stretch")
    # Generators over columns that are there: the wide row of a stretch is not copied for each page.
    moves = met.select("block_key", "stretch", "poss", "held", F.posexplode("idx").alias("i", "page_idx"))
    list_ = F.get("held", _place(BITS))
    found = moves.select("block_key", "stretch", F.get("poss", F.col("i")).alias("pos"), F.size(list_).alias("copies"), F.explode(list_).alias("page"))
    return found.select("block_key", "stretch", F.col("pos").cast("bigint").alias("pos"), "copies", F.col("page.payload").alias("payload"))


def compared(wanted: DataFrame, stored: DataFrame) -> tuple[int, int]:
    """Of two ``gathered`` tables: pairs of rows of one (block_key, pos), and those whose payloads are equal.

    A block's positions within a stretch are compared by their number and two
    64-bit hashes that are joined by exclusive or; only where these differ, a
    page has several payloads or one is null, rows are joined one by one.
    """
    by = ["block_key", "stretch"]
    own = [F.xxhash64(F.lit(seed), "pos", "payload") for seed in (1, 2)]
    sums = [x.groupBy(*by).agg(F.count("*").alias(f"n{k}"), *(F.bit_xor(h).alias(f"h{i}{k}") for i, h in enumerate(own)), (F.max("copies") > 1).alias(f"copied{k}"), (F.count("payload") < F.count("*")).alias(f"null{k}")) for k, x in enumerate((wanted, stored))]
    plain = "n0 = n1 and h00 = h01 and h10 = h11 and not (copied0 or copied1 or null0 or null1)"
    both = written(sums[0].join(sums[1], by).withColumn("plain", F.expr(plain)), "sums")
    total = both.where("plain").agg(F.coalesce(F.sum("n0"), F.lit(0)).alias("n")).first()["n"]
    odd = both.where("not plain").select(*by)
    if odd.isEmpty():
        return total, total
    one, two = (x.join(odd, by, "left_semi").select("block_key", "pos", F.col("payload").alias(name)) for x, name in ((wanted, "page"), (stored, "payload")))
    rest = one.join(two, ["block_key", "pos"]).agg(F.count("*").alias("n"), F.count_if(F.col("page") == F.col("payload")).alias("equal")).first()
    return total + rest["n"], total + rest["equal"]


def winners(reads: DataFrame, order: list[str]) -> DataFrame:
    """(page_idx, block_key, pos): what each page of ``reads`` (order columns, block_key, pages) gets, the last in ``order`` and position."""
    moves = reads.select(*order, "block_key", F.posexplode("pages").alias("pos", "page_idx"))
    last = moves.groupBy("page_idx").agg(F.max(F.struct(*order, "pos", "block_key")).alias("m"))
    return last.select("page_idx", F.col("m.block_key").alias("block_key"), F.col("m.pos").cast("bigint").alias("pos"))


def fetch(asked: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of ``gather(blocks, pages)`` at the positions ``asked`` (block_key, pos) alone; no other position is gathered."""
    at = asked.select("block_key", "pos").distinct().join(blocks.select("block_key", "pages"), "block_key")
    at = at.select("block_key", "pos", F.get("pages", F.col("pos").cast("int")).alias("page_idx"))
    return at.join(pages, "page_idx").select("block_key", "pos", "payload")


def scatter(reads: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """(page_idx, payload) after reads: each position of a block goes to its page, the last in ``order`` and position wins.

    ``reads``: order columns, block_key, pages; ``stored``: block_key, pos,
    payload.  A position that was never stored gives a null payload.
    """
    return settled(winners(reads, order), stored)


def settled(won: DataFrame, stored: DataFrame) -> DataFrame:
    """(page_idx, payload) of ``winners`` from ``stored``: only the winning move of a page fetches a payload."""
    return won.join(stored, ["block_key", "pos"], "left").select("page_idx", "payload")
