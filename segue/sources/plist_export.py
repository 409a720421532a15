"""Property-list (XML) library exports.

A property list alternates key and value siblings, which Spark's XML source cannot
read, so each file is parsed by the standard library inside a task, element by element;
everything after the parse is DataFrame work.  The same parse is a table function for SQL.
"""

from __future__ import annotations

import io
import plistlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers.expat import ExpatError, ParserCreate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..session import materialise
from . import filters, quarantine

_TRACK = {
    "Name": "string", "Artist": "string", "Album": "string", "Album Artist": "string",
    "Total Time": "bigint", "Loved": "boolean", "Year": "int", "Kind": "string",
    "Has Video": "boolean", "Podcast": "boolean", "Movie": "boolean", "TV Show": "boolean",
}
_KINDS = {
    "library_id": "string", "what": "string", "pos": "bigint", "id": "string", "item": "bigint",
    "Smart Info": "boolean", **{flag: "boolean" for flag in fv.SYSTEM_PLAYLIST_FLAGS}, **_TRACK,
}
_ROWS = ", ".join(f"`{name}` {kind}" for name, kind in _KINDS.items())
_ARROW = pa.schema(
    [
        (name, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[kind])
        for name, kind in _KINDS.items()
    ]
)
_ROWS_PER_BATCH = 20_000


def _cast(name: str, value):
    kind = _TRACK[name]
    if value is None:
        return None
    return bool(value) if kind == "boolean" else int(value) if kind in ("int", "bigint") else str(value)


def _value(element) -> object:
    """A scalar of a property list; None for what holds others."""
    text = element.text or ""
    if element.tag in ("true", "false"):
        return element.tag == "true"
    if element.tag == "integer":
        return int(text, 16 if text.lower().startswith("0x") else 10)
    if element.tag == "real":
        return float(text)
    return None if element.tag in ("dict", "array") else text


def _events(content: bytes) -> Iterator[tuple[tuple, object]]:
    """(path, value) of every scalar, and (path, None) at the end of every dict and array.

    A path is the keys and places that lead there.  Elements are dropped as they end, so the
    memory held does not grow with the file.
    """
    path: list = []  # of each open dict its last key, of each open array its last place
    for event, element in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            if element.tag in ("plist", "key"):
                continue
            if path and isinstance(path[-1], int):
                path[-1] += 1
            if element.tag in ("dict", "array"):
                path.append(None if element.tag == "dict" else -1)
        elif element.tag == "key":
            path[-1] = element.text or ""
        elif element.tag != "plist":
            if element.tag in ("dict", "array"):
                path.pop()
            yield tuple(path), _value(element)
            element.clear()


def _file_rows(library_id: str, content: bytes) -> Iterator[dict]:
    """Rows of a file as they are read.  What an XML parser refuses is refused before the first row."""
    if content.startswith(b"bplist"):
        yield from _binary_rows(library_id, content)
        return
    ParserCreate().Parse(content, True)
    n_tracks, held, head = 0, {}, {}
    for path, value in _events(content):
        match path:
            case ("Tracks", _):
                row = {name: _cast(name, held.get(name)) for name in _TRACK}
                yield {"library_id": library_id, "what": "track", "pos": n_tracks, "id": str(path[1]), **row}
                n_tracks, held = n_tracks + 1, {}
            case ("Tracks", _, name):
                held[name] = value
            case ("Playlists", pos):
                flags = {flag: bool(head.get(flag)) for flag in fv.SYSTEM_PLAYLIST_FLAGS}
                flags["Smart Info"] = True if "Smart Info" in head else None
                name = head.get("Name")
                yield {"library_id": library_id, "what": "playlist", "pos": pos, "id": str(pos), "Name": None if name is None else str(name), **flags}
                head = {}
            case ("Playlists", _, name):
                head[name] = value
            case ("Playlists", pos, "Playlist Items", item):
                yield {"library_id": library_id, "what": "item", "pos": pos, "item": item, "id": str(held.get("Track ID"))}
                held = {}
            case ("Playlists", _, "Playlist Items", _, name):
                held[name] = value


def _binary_rows(library_id: str, content: bytes) -> Iterator[dict]:
    root = plistlib.loads(content)
    for pos, (ident, raw) in enumerate(root.get("Tracks", {}).items()):
        row = {name: _cast(name, raw.get(name)) for name in _TRACK}
        yield {"library_id": library_id, "what": "track", "pos": pos, "id": str(ident), **row}
    for pos, raw in enumerate(root.get("Playlists", [])):
        head = {flag: bool(raw.get(flag)) for flag in fv.SYSTEM_PLAYLIST_FLAGS}
        head["Smart Info"] = True if "Smart Info" in raw else None
        yield {"library_id": library_id, "what": "playlist", "pos": pos, "id": str(pos), "Name": raw.get("Name"), **head}
        for item, entry in enumerate(raw.get("Playlist Items", [])):
            yield {"library_id": library_id, "what": "item", "pos": pos, "item": item, "id": str(entry.get("Track ID"))}


def _readable(library_id: str, content: bytes | None) -> Iterator[dict]:
    """Rows of a file; one of kind ``corrupt`` if it is no property list of a library."""
    try:
        yield from _file_rows(library_id, content or b"")
    except (ExpatError, ElementTree.ParseError, plistlib.InvalidFileException, ValueError, TypeError, AttributeError, KeyError, IndexError, OverflowError):
        yield {"library_id": library_id, "what": "corrupt", "pos": 0}


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    for batch in batches:
        for library_id, content in zip(batch["library_id"].to_pylist(), batch["content"].to_pylist()):
            for row in _readable(library_id, content):
                rows.append(row)
                if len(rows) == _ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """(library_id, content) of the files below ``path``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("library_id"), "content")


def parse_exports(files: DataFrame) -> DataFrame:
    """All rows of the exports; ``what`` tells tracks, playlists, playlist items and corrupt files.

    A file that breaks off gives no other row, as its rows are told once it is read.
    """
    return files.select("library_id", "content").mapInArrow(_parse, _ROWS)


def parsed_once(files: DataFrame) -> DataFrame:
    """The rows of ``parse_exports``, written by kind: several tables come from one parse."""
    return materialise(parse_exports(files), "what")


class PropertyList:
    """Table function: ``select ... from files, lateral property_list(library_id, content)``."""

    def eval(self, library_id: str, content: bytes):
        for row in _readable(library_id, content):
            yield tuple(row.get(name) for name in _KINDS)


def register(spark: SparkSession, name: str = "property_list") -> None:
    """Make the parse callable from SQL."""
    spark.udtf.register(name, F.udtf(PropertyList, returnType=_ROWS))


def rejected(rows: DataFrame) -> DataFrame:
    """Files that are no property list, and playlists somebody made that have no name."""
    corrupt = F.when(F.col("what") == "corrupt", "malformed")
    made = (F.col("what") == "playlist") & ~filters.any_flag(fv.SYSTEM_PLAYLIST_FLAGS)
    unnamed = F.when(made, quarantine.nameless_playlist())
    return quarantine.split(rows, "property list", "library_id", F.coalesce(corrupt, unnamed)).rejected


def tracks(rows: DataFrame) -> DataFrame:
    """Music tracks.  The album artist falls back to the artist only where it is absent."""
    artist = F.coalesce("Artist", F.lit(""))
    return filters.music_only(rows.filter("what = 'track'")).select(
        "library_id",
        F.col("id").alias("track_id"),
        "pos",
        F.col("Name").alias("name"),
        artist.alias("artist"),
        F.coalesce("Album", F.lit("")).alias("album"),
        F.coalesce("`Album Artist`", artist).alias("album_artist"),
        F.coalesce("`Total Time`", F.lit(0)).alias("duration_ms"),
        F.coalesce("Loved", F.lit(False)).alias("loved"),
        F.col("Year").alias("year"),
        F.lit(None).cast("string").alias("isrc"),
    )


def items(rows: DataFrame) -> DataFrame:
    """Items of user playlists whose track is music."""
    user = filters.user_playlists(rows.filter("what = 'playlist'")).select(
        "library_id", "pos", F.col("Name").alias("playlist_name"), "smart"
    )
    listed = rows.filter("what = 'item'").select("library_id", "pos", F.col("id").alias("track_id"), "item")
    return filters.valid_items(listed.join(user, ["library_id", "pos"]), tracks(rows)).select(
        "library_id", F.col("pos").alias("playlist_pos"), "playlist_name", "smart", F.col("item").alias("pos"), "track_id"
    )
