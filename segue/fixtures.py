"""The given tables read as libraries, catalogs, decisions and accounts.

Whole tables and whole texts: every document is a playlist whose tracks are its
lines, every page a catalog entry named by its title; every customer nation is a
library whose playlists are its orders and whose tracks are the parts they list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .operators.prepare import with_key


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table with heavy work per row: spread over the cores where its files make few tasks."""
    rows = table(spark, sf, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if 2 * rows.rdd.getNumPartitions() <= cores else rows


# --------------------------------------------------------------------------- texts
def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Every non-blank line of every document, with its place."""
    return (
        text_table(spark, sf, "documents")
        .select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .filter(F.trim("line") != "")
    )


def doc_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as tracks; those of labelled documents carry a code."""
    labelled = table(spark, sf, "labels").select("doc_id", "quality").distinct()
    return (
        doc_lines(spark, sf)
        .join(labelled, "doc_id", "left")
        .select(
            F.col("source").alias("library_id"),
            F.concat_ws("-", "doc_id", "line_no").alias("track_id"),
            (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("pos"),
            F.col("doc_id").cast("string").alias("playlist_id"),
            F.col("line").alias("name"),
            F.col("lang").alias("artist"),
            F.col("source").alias("album"),
            F.col("lang").alias("album_artist"),
            (F.length("line") * 100).cast("bigint").alias("duration_ms"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("loved"),
            F.when(F.col("quality").isNotNull(), F.upper(F.md5("line"))).alias("isrc"),
        )
    )


def page_titles(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    return text_table(spark, sf, "pages").select(
        "page_id",
        F.replace(title, F.lit("&amp;"), F.lit("&")).alias("title"),
        F.split_part("url", F.lit("/"), F.lit(3)).alias("host"),
        F.split_part("url", F.lit("/"), F.lit(4)).alias("lang"),
        F.length("html").alias("n_html"),
    )


def page_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as catalog entries."""
    return page_titles(spark, sf).select(
        F.col("page_id").cast("string").alias("cand_id"),
        F.col("title").alias("name"),
        F.array("lang").alias("artists"),
        F.col("host").alias("album"),
        F.concat_ws("/", "host", "lang").alias("album_id"),
        (F.length("title") / 10.0).alias("duration_s"),
        F.col("n_html").cast("bigint").alias("popularity"),
        F.upper(F.md5("title")).alias("isrc"),
    )


# --------------------------------------------------------------------------- libraries
def _owned_orders(spark: SparkSession, sf: str) -> DataFrame:
    owners = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("library_id")
    )
    return table(spark, sf, "orders").join(owners, "o_custkey")


def playlists(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as playlists of the library of the customer's nation."""
    return _owned_orders(spark, sf).select(
        "library_id",
        F.col("o_orderkey").cast("string").alias("playlist_id"),
        F.col("o_orderkey").alias("pos"),
        F.concat_ws("-", "o_custkey", "o_orderpriority").alias("name"),
        (F.col("o_orderstatus") == "P").alias("smart"),
        (F.col("o_orderstatus") != "F").alias("own"),
        "o_orderstatus",
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as playlist items, numbered in their order.

    Joined by the order's number, by which the lines are dealt and sorted for their numbering.
    """
    in_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(in_order).cast("bigint").alias("pos"))
    owned = _owned_orders(spark, sf).select("library_id", F.col("o_orderkey").alias("l_orderkey"))
    return lines.join(owned, "l_orderkey").select(
        F.col("l_orderkey").cast("string").alias("playlist_id"), "pos", F.col("l_partkey").cast("string").alias("track_id"), "library_id"
    )


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """(library_id, p_partkey): what each library lists, once."""
    owned = _owned_orders(spark, sf).select("library_id", F.col("o_orderkey").alias("l_orderkey"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    return lines.join(owned, "l_orderkey").select("library_id", "p_partkey").distinct()


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey",
        F.col("p_partkey").cast("string").alias("track_id"),
        F.col("p_partkey").alias("pos"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("artist"),
        F.col("p_type").alias("album"),
        F.col("p_brand").alias("album_artist"),
        (F.col("p_size") * 1000).cast("bigint").alias("duration_ms"),
        (F.col("p_size") > 40).alias("loved"),
        F.lit(None).cast("string").alias("isrc"),
    )


def lib_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as tracks of every library that lists them."""
    return _listed(spark, sf).join(_parts(spark, sf), "p_partkey").drop("p_partkey")


def keyed_lib_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """The same with identity keys, computed once per part instead of once per listing."""
    return _listed(spark, sf).join(with_key(_parts(spark, sf)), "p_partkey").drop("p_partkey")


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier decisions on the identity keys of the parts of most types."""
    parts = with_key(
        table(spark, sf, "part")
        .filter("p_type <> 'SMALL'")
        .select("*", F.col("p_name").alias("name"), F.col("p_brand").alias("artist"), F.lit(None).cast("string").alias("isrc"))
    )
    first = parts.groupBy("key").agg(
        F.min(F.struct("p_partkey", "p_type", "p_size", "p_name", "p_brand")).alias("p")
    ).select("key", "p.*")
    matched = F.col("p_type") != "LARGE"
    return first.select(
        "key",
        F.when(matched, F.concat(F.lit("c"), F.col("p_partkey"))).alias("id"),
        (F.col("p_size") * 2.0).alias("score"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist"),
        F.when(matched, F.concat_ws("-", "p_brand", "p_type")).alias("album_id"),
        F.lit(78.0).alias("threshold"),
    )


def albums(spark: SparkSession, sf: str) -> DataFrame:
    """Albums the libraries declare: artist and album of their tracks."""
    coded = ~F.col("album").isin("SMALL", "LARGE")
    return (
        lib_tracks(spark, sf)
        .groupBy("library_id", "artist", "album")
        .agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("track_count"))
        .select(
            "library_id",
            "pos",
            F.col("album").alias("name"),
            "artist",
            "track_count",
            F.when(coded, F.md5(F.concat("artist", "album"))).alias("upc"),
        )
    )


def upc_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog albums by code; albums of type ECONOMY are missing."""
    return table(spark, sf, "part").filter("p_type <> 'ECONOMY'").select(
        F.md5(F.concat("p_brand", "p_type")).alias("upc"),
        F.concat(F.lit("u"), F.col("p_partkey")).alias("album_id"),
        F.col("p_partkey").alias("pos"),
    )


def upc_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Codes already looked up: PROMO ones found, MEDIUM ones known absent."""
    return (
        table(spark, sf, "part")
        .filter("p_type in ('PROMO', 'MEDIUM')")
        .groupBy(F.md5(F.concat("p_brand", "p_type")).alias("upc"), "p_type")
        .agg(F.min("p_partkey").alias("_k"))
        .select("upc", F.when(F.col("p_type") == "PROMO", F.concat(F.lit("m"), F.col("_k"))).alias("album_id"))
    )


def favorites(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as favorites of an account, the market segment telling the kind."""
    kind = (
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "album")
        .when(F.col("c_mktsegment") == "MACHINERY", "artist")
        .otherwise("track")
    )
    return table(spark, sf, "customer").select(
        F.concat(F.lit("n"), F.col("c_nationkey")).alias("library_id"),
        kind.alias("kind"),
        F.concat(F.lit("c"), F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_custkey").alias("pos"),
    )


# --------------------------------------------------------------------------- exports
def _song(line, album: str):
    return F.struct(
        F.md5(line).alias("id"),
        line.alias("name"),
        F.col("lang").alias("artist"),
        F.col(album).alias("album"),
        F.length(line).cast("bigint").alias("duration_ms"),
    )


def json_exports(spark: SparkSession, sf: str) -> DataFrame:
    """One export per document, as JSON text: its lines are the song list, its lines and a
    live version of each a playlist, its source a declared album."""
    lines = F.split("text", "\n")
    export = F.struct(
        F.transform(lines, lambda s: _song(s, "source")).alias("songs"),
        F.array(
            F.struct(
                F.col("source").alias("name"),
                F.transform(
                    F.concat(lines, F.transform(lines, lambda s: F.concat(s, F.lit(" - Live")))), lambda s: _song(s, "lang")
                ).alias("tracks"),
            )
        ).alias("playlists"),
        F.array(
            F.struct(
                F.col("source").alias("name"),
                F.col("lang").alias("artist"),
                F.size(lines).alias("track_count"),
                F.md5("source").alias("upc"),
            )
        ).alias("albums"),
    )
    return text_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("library_id"), F.to_json(export).alias("body")
    )


def _escaped(s):
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(ref))
    return s


def plist_exports(spark: SparkSession, sf: str) -> DataFrame:
    """One property list per document: its lines as tracks, those of a document in
    French as videos where they are short, and a playlist of all of them."""
    lines = F.split("text", "\n")

    def track(line, i):
        kind = F.when((F.length(line) < 40) & (F.col("lang") == "fr"), "MPEG video file").otherwise("audio file")
        return F.concat(
            F.lit("<key>"), i, F.lit("</key><dict><key>Name</key><string>"), _escaped(line),
            F.lit("</string><key>Artist</key><string>"), F.col("lang"),
            F.lit("</string><key>Kind</key><string>"), kind,
            F.lit("</string><key>Total Time</key><integer>"), F.length(line), F.lit("</integer></dict>"),
        )

    def item(line, i):
        return F.concat(F.lit("<dict><key>Track ID</key><integer>"), i, F.lit("</integer></dict>"))

    content = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>Tracks</key><dict>'),
        F.array_join(F.transform(lines, track), ""),
        F.lit("</dict><key>Playlists</key><array><dict><key>Name</key><string>Library</string></dict>"),
        F.lit("<dict><key>Name</key><string>"), F.col("source"),
        F.lit("</string><key>Smart Info</key><data></data><key>Playlist Items</key><array>"),
        F.array_join(F.transform(lines, item), ""),
        F.lit("</array></dict></array></dict></plist>"),
    )
    return text_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("library_id"), F.encode(content, "UTF-8").alias("content")
    )


def _page_item(line, field: str):
    """A line as a track of a stored page; blank lines are null items."""
    track = F.struct(
        F.md5(line).alias("id"),
        line.alias("name"),
        F.when(line.endswith("."), "track").when(line.contains(","), "episode").alias("type"),
        (F.length(line) < 20).alias("is_local"),
        F.length(line).cast("bigint").alias("duration_ms"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("artists"),
        F.struct(F.col("source").alias("name"), F.concat(F.col("n_chars"), F.lit("-01")).alias("release_date")).alias("album"),
    )
    return F.when(F.trim(line) != "", F.struct(track.alias(field)))


def _page(items):
    return F.to_json(F.struct(items.alias("items"))).alias("body")


def page_dumps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as stored pages of their source's collection."""
    return text_table(spark, sf, "documents").select(
        F.col("source").alias("collection"),
        (F.col("doc_id") * 1_000_000).alias("offset"),
        _page(F.transform(F.split("text", "\n"), lambda line: _page_item(line, "track"))),
    )


def playlist_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as playlists of their source, owned by their language, the long ones shared."""
    listed = F.struct(
        F.col("doc_id").cast("string").alias("id"),
        F.concat_ws(" ", "source", "lang").alias("name"),
        (F.col("n_chars") > 2000).alias("collaborative"),
        F.struct(F.col("lang").alias("id")).alias("owner"),
    )
    return table(spark, sf, "documents").select(F.col("source").alias("collection"), F.col("doc_id").alias("offset"), _page(F.array(listed)))


def playlist_item_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of each document as items of its playlist, then a live version of each."""
    lines = F.split("text", "\n")
    both = F.concat(lines, F.transform(lines, lambda s: F.when(F.trim(s) != "", F.concat(s, F.lit(" - Live"))).otherwise("")))
    return text_table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("collection"),
        F.lit(0).cast("bigint").alias("offset"),
        _page(F.transform(both, lambda line: _page_item(line, "item"))),
    )


def album_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as saved albums of their source; French ones have no name."""
    album = F.struct(
        F.when(F.col("lang") != "fr", F.concat_ws(" ", "source", "lang")).alias("name"),
        F.size(F.split("text", "\n")).alias("total_tracks"),
        F.array(F.struct(F.col("lang").alias("name"))).alias("artists"),
        F.struct(F.md5("source").alias("upc")).alias("external_ids"),
    )
    return text_table(spark, sf, "documents").select(
        F.col("source").alias("collection"), F.col("doc_id").alias("offset"), _page(F.array(F.struct(album.alias("album"))))
    )


def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as answers of a track search, one each; those without a language part have no id."""
    item = F.struct(
        F.when(F.col("lang") != "de", F.col("page_id").cast("string")).otherwise("").alias("id"),
        F.col("title").alias("name"),
        F.when(F.col("lang") == "fr", F.col("n_html") < 1000).alias("is_playable"),
        F.array(F.struct(F.col("host").alias("name")), F.struct(F.lit(None).cast("string").alias("name"))).alias("artists"),
        F.struct(F.concat_ws("/", "host", "lang").alias("id"), F.col("host").alias("name")).alias("album"),
        F.when(F.col("lang") == "en", F.length("title") * 1000).otherwise(0).alias("duration_ms"),
        F.col("n_html").alias("popularity"),
        F.struct(F.upper(F.md5("title")).alias("isrc")).alias("external_ids"),
    )
    page = F.struct(F.struct(F.array(item).alias("items")).alias("tracks"))
    return page_titles(spark, sf).select(F.col("host").alias("collection"), F.col("page_id").alias("offset"), F.to_json(page).alias("body"))

