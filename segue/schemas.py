"""Table schemas, and the schemas of the exports that are read."""

DECISIONS = (
    "key string, id string, score double, title string, artist string, album_id string, threshold double"
)
UPC_DECISIONS = "upc string, album_id string"

_SONG = (
    "id: string, name: string, artist: string, album: string, album_artist: string, "
    "duration_ms: bigint, isrc: string, year: string"
)
JSON_EXPORT = (
    f"songs array<struct<{_SONG}, loved: boolean>>, "
    f"playlists array<struct<name: string, tracks: array<struct<{_SONG}>>>>, "
    "albums array<struct<name: string, artist: string, track_count: int, upc: string>>"
)

_ARTISTS = "artists: array<struct<name: string>>"
_ITEM = (
    "id: string, name: string, type: string, is_local: boolean, is_playable: boolean, "
    f"duration_ms: bigint, popularity: int, {_ARTISTS}, external_ids: struct<isrc: string>, "
    f"album: struct<id: string, name: string, release_date: string, {_ARTISTS}>"
)
TRACK_PAGE = f"items array<struct<track: struct<{_ITEM}>, item: struct<{_ITEM}>>>"
SEARCH_PAGE = f"items array<struct<{_ITEM}>>"
ALBUM_PAGE = (
    f"items array<struct<album: struct<id: string, name: string, total_tracks: int, {_ARTISTS}, "
    "external_ids: struct<upc: string>>>>"
)
PLAYLIST_PAGE = "items array<struct<id: string, name: string, collaborative: boolean, owner: struct<id: string>>>"
