"""FIXED VALUES.

Word lists, thresholds, sizes and formats that have to be exactly these for the
results to be right.  They are data, not design: nothing here is tunable without
changing what the engine reports.
"""

# Segments cut from the end of a title, when they follow an opening bracket or dash.
TITLE_OPENERS = "([-–—"
TITLE_CLOSERS = ")]"
TITLE_JUNK_WORDS = [
    r"feat\.?",
    r"ft\.?",
    "featuring",
    "remaster",
    "remastered",
    r"\d{4} remaster",
    "mono",
    "stereo",
    "live",
    "edit",
    "radio edit",
    "single version",
    "album version",
    "deluxe",
    "bonus track",
    "explicit",
    "clean",
    "original mix",
    "extended",
    "version",
    "remix",
]

# Words that start the guest part of an artist name, and what separates artists.
GUEST_WORDS = [r"feat\.?", r"ft\.?", "featuring"]
ARTIST_SEPARATORS = ",&/"
ARTIST_SEPARATOR_WORD = "x"

# Identity keys.
CODE_KEY_PREFIX = "isrc:"
NAME_KEY_PREFIX = "q:"
ALBUM_CODE_KEY_PREFIX = "upc:"

# Score of a pair: weights, duration penalties (seconds, points), exact-title bonus.
TITLE_WEIGHT = 0.55
ARTIST_WEIGHT = 0.35
ALBUM_WEIGHT = 0.10
FAR_SECONDS, FAR_PENALTY = 20.0, 25.0
NEAR_SECONDS, NEAR_PENALTY = 5.0, 8.0
EXACT_TITLE_BONUS = 3.0

# Decisions.
CODE_MATCH_SCORE = 100.0
DEFAULT_THRESHOLD = 78.0
GOOD_ENOUGH_SCORE = 92.0
SEARCH_LIMIT = 12

# Albums guessed from tracks.
GUESS_MIN_TRACKS = 3
GUESS_MIN_SHARE = 0.8

# Batch sizes of write plans.
PLAYLIST_CHUNK = 100
FAVORITES_CHUNK = 50
LIBRARY_CHUNK = 40
PREVIEW_NAMES = 5

# Property-list exports: playlist flags and names that mark a system playlist.
SYSTEM_PLAYLIST_FLAGS = [
    "Master",
    "Music",
    "Movies",
    "TV Shows",
    "Podcasts",
    "Audiobooks",
    "Purchased",
    "Distinguished Kind",
    "Folder",
]
SYSTEM_PLAYLIST_NAMES = ["Bibliothèque", "Library", "Musique", "Music"]
NON_MUSIC_FLAGS = ["Has Video", "Podcast", "Movie", "TV Show"]
VIDEO_KIND_MARK = "vid"

# Report columns and separators.
REPORT_COLUMNS = ["artist", "title", "album", "best_score", "playlists"]
REPORT_DECIMALS = 1
REPORT_NAME_SEPARATOR = "; "
SAVED_AT_FORMAT = "yyyy-MM-dd HH:mm:ss"
