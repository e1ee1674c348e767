"""Which releases may be shown: the visibility policy, optional filters, overrides, and pages of the listing."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headerloom.operators.merge import all_of

# The ids of each browse category by slug, and the id of releases without a category.
BROWSE = {
    "console": {"nds": 1010, "psp": 1020, "wii": 1030, "switch": 1035, "xbox": 1040, "xbox-360": 1050, "ps3": 1080, "xbox-one": 1090, "ps4": 1100},
    "movies": {"foreign": 2010, "other": 2020, "sd": 2030, "hd": 2040, "uhd": 2045, "bluray": 2050, "3d": 2060},
    "audio": {"mp3": 3010, "video": 3020, "audiobook": 3030, "lossless": 3040, "podcast": 3050},
    "pc": {"0day": 4010, "iso": 4020, "mac": 4030, "mobile-other": 4040, "games": 4050, "mobile-ios": 4060, "mobile-android": 4070, "3dmodels": 4080},
    "tv": {"foreign": 5020, "sd": 5030, "hd": 5040, "uhd": 5045, "other": 5050, "sport": 5060, "anime": 5070, "documentary": 5080},
    "xxx": {"dvd": 6010, "wmv": 6020, "sd": 6030, "hd": 6040, "uhd": 6045, "pack": 6050, "imgset": 6060, "other": 6070},
    "books": {"mags": 7010, "ebook": 7020, "comics": 7030},
    "other": {"misc": 8010},
}
MISC = 8010
# Titles that name nothing.
EMPTY_TITLES = ["vip", "vip only", "private", "private release", "exclusive", "unknown"]
_VOLUME = r"(part|vol)[0-9]+([+._-][0-9]+)?"


@dataclass(frozen=True)
class Policy:
    """Bounds and switches of the visibility policy."""

    match_confidence: float = 0.55
    completion: float = 100.0
    identified_only: bool = False
    inspection: bool = True
    enrichment: bool = False
    clear_title: bool = True
    payload_complete: bool = True
    expected_files: bool = False
    par2: bool = False
    nfo: bool = False
    sfv: bool = False


def with_overrides(releases: DataFrame, overrides: DataFrame) -> DataFrame:
    """releases with their row of overrides (release_id and columns that start with ``o_``), nulls where there is none."""
    return releases.join(overrides, "release_id", "left")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _number(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def effective_title() -> Column:
    """The title to show: the override's unless blank."""
    return F.coalesce(F.nullif("o_title", F.lit("")), "title")


def overridden(override: str, base: str) -> Column:
    """A number that is the override's where that is positive."""
    return F.when(_number(override) > 0, F.col(override)).otherwise(F.col(base))


def password_state() -> Column:
    said = _text("password_state")
    return (
        F.when(_flag("passworded_known") | said.isin("password_known", "passworded_known"), "password_known")
        .when(_flag("passworded_unknown") | _flag("passworded") | said.isin("password_unknown", "passworded_unknown", "passworded"), "password_unknown")
        .when(said == "not_passworded", "not_passworded").otherwise("unknown")
    )


def _title() -> Column:
    return F.lower(F.trim(F.coalesce(effective_title(), F.lit(""))))


def clear_title() -> Column:
    """A title in plain words: not blank, not a placeholder, no single opaque token, not from an obfuscated source."""
    t = _title()
    return (t != "") & (t != "unknown-release") & ~t.isin(EMPTY_TITLES) & ~t.rlike(rf"^[a-z0-9]{{12,}}(\s+{_VOLUME})?$") & (_text("title_source") != "source_obfuscated")


def weak_title() -> Column:
    """A probable, uncategorised release whose title is an opaque token or ends in a volume."""
    t = _title()
    return (_text("identity_status") == "probable") & (F.coalesce("category_id", F.lit(MISC)) == MISC) & (t.rlike(rf"(^|\s){_VOLUME}$") | t.rlike(rf"^[a-z0-9]{{12,}}(\s+{_VOLUME})?$"))


def opaque_title_without_evidence() -> Column:
    """A long opaque token, with nothing else known of the release."""
    texts = ["deobfuscated_title", "matched_media_title", "original_media_title", "external_media_type", "primary_resolution", "primary_video_codec", "primary_audio_codec"]
    nothing = [_text(c) == "" for c in texts] + [_number(c) <= 0 for c in ("tmdb_id", "tvdb_id", "runtime_seconds")] + [~_flag("has_nfo")]
    return _title().rlike(rf"^[a-z0-9]{{16,}}(\s+{_VOLUME})?$") & all_of(nothing)


def payload_complete() -> Column:
    enough = F.greatest(_number("file_count") - _number("par_file_count"), F.lit(0)) >= _number("expected_archive_files")
    return F.when(_number("archive_count") > 0, (_number("expected_archive_files") > 0) & enough).otherwise((_number("expected_archive_files") <= 0) | enough)


def inspected() -> Column:
    texts = ["primary_resolution", "primary_video_codec", "primary_audio_codec"]
    return F.coalesce(F.col("runtime_seconds") > 0, F.lit(False)) | (F.concat(*[_text(c) for c in texts]) != "") | _flag("has_nfo") | _flag("has_par2")


def enriched() -> Column:
    return F.coalesce(F.col("tmdb_id") > 0, F.lit(False)) | F.coalesce(F.col("tvdb_id") > 0, F.lit(False)) | (_text("external_media_type") != "") | (_text("matched_media_title") != "")


def visible_if(policy: Policy) -> Column:
    """The policy as one condition; the rows need has_files and has_archive, and has_sfv (see evidence())."""
    status = ["identified"] if policy.identified_only else ["identified", "probable"]
    group = r"(?i)(^|[._-])(seed|test)([._-]|$)"
    fixed = [
        _text("search_title") != "", _flag("has_files") | _flag("has_archive"), _title() != "unknown-release", _number("match_confidence") >= policy.match_confidence,
        _number("completion") >= policy.completion, _text("identity_status").isin(status), _number("size_bytes") > 0, (_number("expected_files") <= 1) | (_number("file_count") >= 2),
        ~(_text("search_title").rlike(r"(?i)(^|[^a-z0-9])(seed|test)([^a-z0-9]|$)") | _text("group_name").rlike(group)), ~weak_title(), ~opaque_title_without_evidence(),
        password_state().isin("not_passworded", "password_known"), ~_flag("o_hidden"),
    ]
    switched = {
        clear_title: policy.clear_title, inspected: policy.inspection, enriched: policy.enrichment, payload_complete: policy.payload_complete,
        (lambda: (_number("expected_files") <= 0) | (_number("file_count") >= _number("expected_files"))): policy.expected_files,
        (lambda: _flag("has_par2")): policy.par2, (lambda: _flag("has_nfo")): policy.nfo, (lambda: _flag("has_sfv")): policy.sfv,
    }
    return all_of(fixed + [condition() for condition, on in switched.items() if on])


def evidence(releases: DataFrame, files: DataFrame, archives: DataFrame, catalog_files: DataFrame) -> DataFrame:
    """releases with has_files, has_archive (stored, with an object) and has_sfv: three EXISTS as left joins of distinct keys."""
    stored = archives.where(F.col("archive_status").isin("archived", "purge_pending", "purged") & (_text("object_key") != ""))
    listed = catalog_files.where(F.lower(_text("file_name")).like("%.sfv"))
    out = releases
    for name, rows in {"has_files": files, "has_archive": stored, "has_sfv": listed}.items():
        out = out.join(rows.select("release_id", F.lit(True).alias(name)).distinct(), "release_id", "left")
    return out


def browse_ids(category: str, subcategory: str = "") -> list[int]:
    """The ids of a browse category; of one subcategory if named and not ``all``; none if a name is unknown."""
    subs = BROWSE.get(category.strip().lower(), {})
    sub = subcategory.strip().lower()
    return list(subs.values()) if sub in ("", "all") else [subs[sub]] if sub in subs else []


def browsed(category: str, subcategory: str = "") -> Column | None:
    """The condition of a browse category; null categories count as misc. None if it names no ids, and so filters nothing."""
    ids = browse_ids(category, subcategory)
    return F.coalesce("category_id", F.lit(MISC)).isin(ids) if ids else None


def filters(
    query: str = "", classification: str = "", category: str = "", subcategory: str = "", has_nfo: bool | None = None, has_par2: bool | None = None, password: str = "", availability_tier: str = "",
    media_quality_tier: str = "", least_completion: float = 0, posted_after: dt.datetime | None = None, posted_before: dt.datetime | None = None, least_size: int = 0, most_size: int = 0, imdb_id: str = "",
    tvdb_id: int = 0, season: int = 0, episode: int = 0, metadata: str = "",
) -> list[Column]:
    """The conditions of the optional filters that are given; blank texts, zeros and None filter nothing."""
    imdb = imdb_id.strip().lower().removeprefix("tt")
    literal = query.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    given = [
        (literal, lambda: F.col("search_title").ilike(f"%{literal}%")), (classification.strip(), lambda: F.col("classification") == classification.strip()),
        (browse_ids(category, subcategory), lambda: browsed(category, subcategory)), (has_nfo is not None, lambda: F.col("has_nfo") == has_nfo), (has_par2 is not None, lambda: F.col("has_par2") == has_par2),
        (password.strip(), lambda: password_state() == password.strip()), (availability_tier.strip(), lambda: F.col("availability_tier") == availability_tier.strip()),
        (media_quality_tier.strip(), lambda: F.col("media_quality_tier") == media_quality_tier.strip()), (least_completion > 0, lambda: F.col("completion") >= least_completion),
        (posted_after, lambda: F.col("posted_at") >= F.lit(posted_after).cast("timestamp_ntz")), (posted_before, lambda: F.col("posted_at") <= F.lit(posted_before).cast("timestamp_ntz")),
        (least_size > 0, lambda: F.col("size_bytes") >= least_size), (most_size > 0, lambda: F.col("size_bytes") <= most_size),
        (imdb, lambda: F.lower(_text("o_imdb_id")).isin(imdb, f"tt{imdb}")), (tvdb_id > 0, lambda: overridden("o_tvdb_id", "tvdb_id") == tvdb_id),
        (season > 0, lambda: F.col("season") == season), (episode > 0, lambda: F.col("episode") == episode),
        (metadata in ("updated", "missing"), lambda: F.col("metadata_updated_at").isNotNull() if metadata == "updated" else F.col("metadata_updated_at").isNull()),
    ]
    return [condition() for value, condition in given if value]


def listing_order(sort: str) -> list[Column]:
    """The declared order of a sort mode, and the release_id after it."""
    posted, title = F.desc_nulls_last("posted_at"), effective_title().asc_nulls_last()
    orders = {
        "posted_at_asc": [F.asc_nulls_last("posted_at"), F.desc_nulls_first("updated_at"), title], "size_desc": [F.desc_nulls_first("size_bytes"), posted, title],
        "size_asc": [F.asc_nulls_last("size_bytes"), posted, title], "title_asc": [title, posted], "availability_desc": [F.desc_nulls_first("availability_score"), posted, title],
        "quality_desc": [F.desc_nulls_first("media_quality_score"), posted, title],
    }
    return [*orders.get(sort, [posted, F.desc_nulls_first("updated_at"), title]), F.asc("release_id")]


def shown() -> list[Column]:
    """The columns of a listing, with overrides in their places."""
    return [
        F.col("release_id"), effective_title().alias("title"), F.col("posted_at"), F.col("size_bytes"), F.col("category_id"),
        F.coalesce(F.nullif("o_classification", F.lit("")), "classification").alias("classification"), password_state().alias("password"),
        overridden("o_tmdb_id", "tmdb_id").alias("tmdb_id"), overridden("o_tvdb_id", "tvdb_id").alias("tvdb_id"),
        F.coalesce(F.nullif("o_title", F.lit("")), F.nullif("original_media_title", F.lit("")), "title").alias("media_title"), _text("o_imdb_id").alias("imdb_id"),
    ]


def page(releases: DataFrame, policy: Policy, conditions: list[Column], sort: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one page of the visible releases that meet the conditions, the number of all of them as one row)."""
    found = releases.where(all_of([visible_if(policy), *conditions]))
    return found.orderBy(*listing_order(sort)).offset(max(offset, 0)).limit(limit if limit > 0 else 50).select(*shown()), found.agg(F.count("*").alias("total"))


def detail(releases: DataFrame, files: DataFrame, release_id, policy: Policy) -> DataFrame:
    """One visible release with its media summary and its files in order; no row if it is not visible."""
    ordered = F.array_sort(F.collect_list(F.struct("file_index", "file_name", "size_bytes")))
    listed = files.where(F.col("release_id") == release_id).groupBy("release_id").agg(ordered.alias("files"), F.sum("size_bytes").alias("file_bytes"))
    media = F.concat_ws(" / ", *[F.nullif(c, F.lit("")) for c in ("primary_resolution", "primary_video_codec", "primary_audio_codec")])
    one = releases.where((F.col("release_id") == release_id) & visible_if(policy)).select(*shown(), media.alias("media"))
    return one.join(listed, "release_id", "left")


def admin_filters(values: dict[str, str], predicates: dict[str, dict[str, Column]]) -> list[Column]:
    """Conditions of the admin list: for each filter the comma-separated values that it knows, joined by OR; unknown and blank ones are left out."""
    out = []
    for name, known in predicates.items():
        chosen = [known[v.strip().lower()] for v in values.get(name, "").split(",") if v.strip().lower() in known]
        if chosen:
            condition = chosen[0]
            for one in chosen[1:]:
                condition = condition | one
            out.append(condition)
    return out


def admin_predicates(default: Policy = Policy()) -> dict[str, dict[str, Column]]:
    """What the admin list can be filtered by, and the condition of each value."""
    hidden, public = _flag("o_hidden"), visible_if(default)
    one_of = lambda c, *values: {v: F.col(c) == v for v in values}
    yes_no = lambda c: {"yes": c, "no": ~c}
    mismatch = (_text("matched_media_title") != "") & (_number("tvdb_id") == 0) & ((_text("external_media_type") == "tv") | (_text("external_media_type") != "") & (_number("tmdb_id") == 0))
    return {
        "classification": one_of("classification", "video", "video_archive", "tv", "movie", "audio", "ebook", "archive", "misc"), "media": one_of("external_media_type", "movie", "tv", "audio"),
        "identity": one_of("identity_status", "identified", "probable", "unknown"), "password": {v: password_state() == v for v in ("not_passworded", "password_known", "password_unknown", "unknown")},
        "hidden": {"hidden": hidden, "visible": ~hidden}, "public": {"public": public, "internal_only": ~public & ~hidden, "hidden": hidden}, "inspected": yes_no(inspected()), "enriched": yes_no(enriched()),
        "uncategorized": {"yes": F.col("category_id") == MISC, "no": F.col("category_id") != MISC}, "mismatch": yes_no(mismatch),
        "low_confidence": {"yes": _number("match_confidence") < 0.8, "no": _number("match_confidence") >= 0.8}, "completion": {"exact_100": F.col("completion") == 100, "below_100": F.col("completion") < 100},
    }
