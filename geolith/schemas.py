"""Schemas of the tables that the engine reads and writes. Missing text is the empty string, not null."""

from __future__ import annotations

from enum import IntEnum

#: A raw gazetteer dump has 19 positional columns.
RAW = (
    "geonameid string, name string, asciiname string, alternates string, lat string, lon string, feature_class string, feature_code string, iso2 string, cc2 string, "
    "admin1_code string, admin2_code string, admin3_code string, admin4_code string, population string, elevation string, dem string, timezone string, modified string"
)
GAZETTEER = (
    "geonameid string, name string, asciiname string, alternativenames array<string>, lat double, lon double, feature_class string, feature_code string, country_code3 string, "
    "admin1_code string, admin1_name string, admin2_code string, admin2_name string, admin3_code string, admin4_code string, population long, alt_name_length int, modification_date date"
)
ADMIN = "code string, name string, ascii string, geonameid string"
HIERARCHY = "parent_id string, child_id string, kind string"
TOKEN = "struct<text: string, start: int, end: int, sentence: int, label: string>"
MENTION = "doc_id long, mention_id int, search_name string, start_char int, end_char int, label string, sentence int, in_rel string"
STORY = "Headline string, Rawtext string, storyid long, events array<struct<event_id: long, text: string, name: string, sentence_num: int>>"
#: Fixed: the 26 columns of event-coded news, in the order of its headerless tab-separated files.
CODED_EVENT_COLUMNS = (
    "Event ID", "Event Date", "Source Name", "Source Sectors", "Source Country", "Event Text", "CAMEO Code", "Intensity", "Target Name", "Target Sectors", "Target Country", "Story ID", "Sentence Number",
    "Event Sentence", "Publisher", "Source", "Headline", "City", "District", "Province", "Country", "Latitude", "Longitude", "productID", "holdingID", "Language",
)
CODED_EVENT = ", ".join(f"`{x}` string" for x in CODED_EVENT_COLUMNS)
#: What a resolved mention carries from the gazetteer.
PLACE = ("geonameid", "name", "lat", "lon", "feature_class", "feature_code", "country_code3", "admin1_code", "admin1_name", "admin2_code", "admin2_name")


class DataExtent(IntEnum):
    """How much of a gazetteer is there."""

    NA = 0
    NONE = 1
    TEST = 2
    ALL = 3
