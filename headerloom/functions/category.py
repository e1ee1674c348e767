"""Category of a release from its title words and its evidence, as nested ``when`` over one normalised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that name a kind, and the category ids with the words that choose them, first match first.
KIND_WORDS = {
    "xxx": ["xxx", "porn", "nsfw", "onlyfans", "brazzers", "playboy", "erotica"],
    "console": ["ps3", "ps4", "ps5", "playstation", "xbox", "x360", "xboxone", "switch", "nintendo", "wii", "psp", "nds", "3ds"],
    "movie": ["bluray", "bdrip", "dvdrip", "remux"],
    "audio": ["flac", "mp3", "album", "discography", "podcast", "audiobook"],
    "books": ["ebook", "epub", "mobi", "pdf", "comic", "magazine", "manga"],
    "pc": ["windows", "mac", "android", "ios", "ipa", "apk", "game", "steam", "software", "0day", "trainer", "stl", "steinberg", "cubase", "nuendo", "ableton", "autodesk", "adobe", "microsoft office"],
}
CHOICES = {
    "xxx": [(6060, ["imgset", "photoset"]), (6050, ["pack"]), (6020, ["wmv"]), (6010, ["dvd"])],
    "console": [(1035, ["switch", "nintendo switch"]), (1100, ["ps4", "playstation 4"]), (1080, ["ps3", "playstation 3"]), (1090, ["xbox one", "xbone"]), (1050, ["xbox 360", "x360"]), (1040, ["xbox"]), (1030, ["wii"]), (1020, ["psp"]), (1010, ["nds", "3ds"])],
    "tv": [(5070, ["anime"]), (5080, ["documentary", "docu"]), (5060, ["sport", "sports", "ufc", "wwe", "formula", "motogp", "nba", "nfl", "mlb", "nhl"]), (5020, ["foreign", "german", "french", "spanish", "nlsubs"])],
    "movie": [(2060, ["3d"]), (2010, ["foreign", "french", "german", "spanish", "ita", "nlsubs"])],
    "audio": [(3030, ["audiobook"]), (3050, ["podcast"]), (3040, ["flac", "lossless"]), (3010, ["mp3"]), (3020, ["music video", "concert"])],
    "books": [(7030, ["comic", "comics", "manga"]), (7010, ["magazine", "mags"])],
    "pc": [(4070, ["android", "apk"]), (4060, ["ios", "iphone", "ipad", "ipa"]), (4040, ["mobile"]), (4030, ["mac", "osx", "macos"]), (4050, ["game", "steam", "gog", "repack"]), (4020, ["iso"]), (4080, ["stl", "3d print", "3dprint"]), (4010, ["0day", "steinberg", "cubase", "nuendo", "ableton", "autodesk", "adobe", "microsoft office", "software"])],
}
#: uhd, hd, sd, other of the kinds that are told apart by resolution.
RESOLUTION_IDS = {"xxx": (6045, 6040, 6030, 6070), "tv": (5045, 5040, 5030, 5050), "movie": (2045, 2040, 2030, 2020)}
SD_WORDS = {"xxx": ["480p", "576p"], "tv": ["480p", "576p"], "movie": ["dvdrip", "xvid", "480p", "576p"]}
BLURAY, BLURAY_WORDS = 2050, ["bluray", "blu ray", "bdrip", "bdremux"]
DEFAULTS = {"console": 1000, "audio": 3000, "books": 7020, "pc": 4000}
MISC = 8010


def words_of(*texts: Column) -> Column:
    """The lower-cased texts, separators as spaces, with one space at either end; null texts are left out."""
    return F.concat(F.lit(" "), F.translate(F.concat_ws(" ", *[F.lower(F.trim(t)) for t in texts]), "._-/\\()[]", " " * 9), F.lit(" "))


def has_any(text: Column, words: list[str]) -> Column:
    return text.rlike(f" ({'|'.join(words)}) ")


def has_episode(text: Column) -> Column:
    return text.rlike(r"\bs\d{1,2}e\d{1,3}\b|\b\d{1,2}x\d{1,3}\b|\b20\d{2} \d{2} \d{2}\b")


def category_kind(text: Column, classification: Column, media_type: Column, predb_category: Column, audio_codec: Column, tv_id: Column, movie_id: Column) -> Column:
    """The kind of a release; the first rule that holds decides. ``text`` is from ``words_of``; the others may be null."""
    said, media, predb, codec = (F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (classification, media_type, predb_category, audio_codec))
    some = lambda c: F.coalesce(c > 0, F.lit(False))
    years = "19[5-9][0-9]|20[0-9][0-9]"
    sound = said.isin("audio") | media.isin("audio") | (~said.isin("video", "video_archive") & ~media.isin("video") & ((codec != "") | has_any(text, KIND_WORDS["audio"])))
    return (
        F.when((said == "xxx") | has_any(text, KIND_WORDS["xxx"]), "xxx").when(has_any(text, KIND_WORDS["console"]), "console")
        .when(some(tv_id) | (media == "tv") | has_episode(text), "tv").when(some(movie_id) | (media == "movie"), "movie")
        .when(predb.startswith("tv"), "tv").when(predb.startswith("movie"), "movie").when(said == "tv", "tv")
        .when((said == "movie") | has_any(text, KIND_WORDS["movie"]) | text.rlike(f" ({years}) "), "movie").when(sound, "audio")
        .when((said == "ebook") | has_any(text, KIND_WORDS["books"]), "books")
        .when(said.isin("software", "software_archive", "pc") | has_any(text, KIND_WORDS["pc"]), "pc").otherwise("misc")
    )


def category_id(kind: Column, text: Column, resolution: Column, classification: Column | None = None, audio_codec: Column | None = None) -> Column:
    """The id within a kind: words first, then the resolution or the kind's default."""
    name = F.lower(F.trim(F.coalesce(resolution, F.lit(""))))
    tier = F.when(name.isin("2160p", "4k", "uhd"), 2).when(name.isin("720p", "1080p"), 1).otherwise(0)
    said, codec = (F.lit("") if c is None else F.lower(F.trim(F.coalesce(c, F.lit("")))) for c in (classification, audio_codec))
    found = F.lit(MISC)
    for one, rules in CHOICES.items():
        extra = {3040: codec.contains("flac"), 3010: codec.contains("mp3"), 4010: said.isin("software", "software_archive")}
        picks = [F.when(has_any(text, words) | extra[i] if i in extra else has_any(text, words), i) for i, words in rules]
        if one == "movie":
            picks.append(F.when(has_any(text, BLURAY_WORDS) & (tier == 0), BLURAY))
        if one in RESOLUTION_IDS:
            uhd, hd, sd, other = RESOLUTION_IDS[one]
            picks.append(F.when(tier == 2, uhd).when(tier == 1, hd).when(has_any(text, SD_WORDS[one]), sd).otherwise(other))
        else:
            picks.append(F.lit(DEFAULTS[one]))
        found = F.when(kind == one, F.coalesce(*picks)).otherwise(found)
    return found.cast("int")
