"""Explicit schemas of the tables the jobs exchange."""

# One row per listed artist of a release file; attributes carry a leading underscore.
_CREDITED = "array<struct<anv:string,id:bigint,join:string,name:string,role:string,tracks:string>>"
_CREDITS = f"struct<artist:{_CREDITED}>"

RELEASE_XML = (
    "_id bigint, master_id struct<_VALUE:bigint,_is_main_release:string>, title string, released string, "
    "country string, genres struct<genre:array<string>>, "
    "formats struct<format:array<struct<descriptions:struct<description:array<string>>>>>, "
    "labels struct<label:array<struct<_name:string>>>, notes string, "
    f"artists {_CREDITS}, extraartists {_CREDITS}, "
    f"tracklist struct<track:array<struct<artists:{_CREDITS},extraartists:{_CREDITS}>>>"
)

_NAMES = "struct<name:array<struct<_VALUE:string,_id:bigint>>>"

ARTIST_XML = (
    f"id bigint, name string, realname string, aliases {_NAMES}, namevariations struct<name:array<string>>, "
    f"groups {_NAMES}, members struct<id:array<bigint>,name:array<struct<_VALUE:string,_id:bigint>>>, "
    "urls struct<url:array<string>>, profile string"
)

PEOPLE = "id bigint, name string"
RELEVANTS = "id bigint, name string, category int"
SELECTION = "discogs_id string, musicbrainz_id string, wikidata_id string"

# Relational dump: (position, name, type) of the columns that are read.
DUMP_COLUMNS = {
    "artist": [(0, "id", "bigint"), (1, "musicbrainz_id", "string"), (2, "artist_name", "string"),
               (10, "type", "string"), (11, "areaID", "bigint")],
    "area_area": [(3, "areaID", "bigint"), (2, "area2ID", "bigint")],
    "area": [(0, "areaID", "bigint"), (2, "area_name", "string"), (3, "area_type", "int")],
    "url": [(0, "urlID", "bigint"), (2, "url", "string")],
    "artist_url": [(2, "id", "bigint"), (3, "urlID", "bigint")],
}
