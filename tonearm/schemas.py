"""Shapes of the landed records, and the genre rules as data."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StructType
_F = T.StructField
ARTIST = _S([_F("id", T.StringType()), _F("name", T.StringType())])
TRACK = _S(
    [
        _F("id", T.StringType()),
        _F("name", T.StringType()),
        _F("uri", T.StringType()),
        _F("is_local", T.BooleanType()),
        _F("is_playable", T.BooleanType()),
        _F("album", _S([_F("name", T.StringType())])),
        _F("artists", T.ArrayType(ARTIST)),
        _F("url", T.StringType()),
    ]
)
PLAYLIST = _S(
    [
        _F("id", T.StringType()),
        _F("name", T.StringType()),
        _F("collaborative", T.BooleanType()),
        _F("snapshot_id", T.StringType()),
        _F("owner", _S([_F("id", T.StringType())])),
        _F("items", _S([_F("total", T.LongType())])),
        _F("tracks", _S([_F("total", T.LongType())])),
    ]
)
FULL_ARTIST = _S([_F("id", T.StringType()), _F("name", T.StringType()), _F("genres", T.ArrayType(T.StringType()))])


def page_of(item: T.DataType) -> T.StructType:
    """A landed page: whose it is, the list it belongs to, its offset and its items."""
    return _S([_F("user_id", T.StringType()), _F("playlist_id", T.StringType()), _F("offset", T.LongType()), _F("next", T.StringType()), _F("items", T.ArrayType(item))])


LIKED_PAGE = page_of(_S([_F("added_at", T.StringType()), _F("track", TRACK)]))
ITEM_PAGE = page_of(_S([_F("added_at", T.StringType()), _F("is_local", T.BooleanType()), _F("item", TRACK)]))
PLAYLIST_PAGE = page_of(PLAYLIST)
ARTIST_BATCH = _S([_F("seq", T.LongType()), _F("artists", T.ArrayType(FULL_ARTIST))])

OTHER = "Other"
#: Bucket and its keywords, in order of priority; a genre falls to the first with a keyword inside it.
RULES = [
    ("Hip Hop", "hip hop, rap, trap, drill, grime, phonk, plugg, cloud rap, boom bap, crunk, mumble"),
    ("R&B", "r&b, soul, neo soul, funk, motown, quiet storm"),
    ("Metal", "metal, metalcore, deathcore"),
    ("Jazz", "jazz, bebop, swing, blues, bossa nova"),
    ("Classical", "classical, orchestral, opera, baroque, symphony, chamber"),
    ("Country", "country, bluegrass, americana, outlaw, cowboy, western"),
    ("Latin", "latin, reggaeton, salsa, cumbia, bachata, sertanejo, banda, corrido, norteno"),
    ("Reggae", "reggae, ska, dub"),
    ("Folk", "folk, singer-songwriter, acoustic"),
    ("Punk", "punk, hardcore, emo, post-hardcore"),
    ("Electronic", "electronic, house, techno, edm, dubstep, drum and bass, dnb, trance, synth, electro, vaporwave, chillwave, lo-fi, lofi, vapor, glitch, breakbeat, rave, club"),
    ("Indie", "indie, dream pop, shoegaze, bedroom pop, jangle, chillgaze"),
    ("Alternative", "alternative, alt-"),
    ("Rock", "rock, grunge, hard rock"),
    ("Pop", "pop, k-pop, j-pop, dance"),
]
BUCKETS = [b for b, _ in RULES] + [OTHER]
RULE_ROWS = [(i, k, b) for i, (b, words) in enumerate(RULES, 1) for k in words.split(", ")]

#: Genre strings of the derived library.
VOCAB = ["dark trap", "neo soul", "death metal", "latin jazz", "chamber pop", "alt-country", "reggaeton", "dubstep", "skate punk", "indie folk", "pop punk", "deep house", "lo-fi beats", "shoegaze", "alternative metal", "classic rock", "k-pop", "hip-hop", "unknown xyz", "", "SYNTHPOP", "Bossa Nova", "rap metal", "emo"]
