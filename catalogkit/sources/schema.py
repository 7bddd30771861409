"""Explicit schemas; items may lack any field, and unreadable ones keep their text."""

#: fixed values: the field names of the data
ITEMS = (
    "code string, title string, date string, owner string, cast array<string>, series string, maker string, label string, publisher string, "
    "duration string, director string, tags array<string>, labels array<string>, synopsis string, rating double, rating_count int, "
    "external_links map<string,string>, cover string, poster string, background string, sample_images array<string>, trailer string, "
    "segments int, source string, source_url string, updated_at string, _corrupt_record string"
)
ENTITIES = (
    "name string, aliases array<string>, `group` string, avatar string, bio string, status string, debut_date string, debut_year int, "
    "retire_date string, comeback_date string, status_source string, source string, updated_at string, _corrupt_record string"
)
TAG_SOURCES = ("id", "url", "ja", "zh_cn", "zh_tw", "en", "translate", "note")
