"""Red-list text lines → records, merging of editions, and matching with the checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import names
from lacuna.operators.joins import spread_join
from lacuna.operators.ranking import CHUNK, carry_forward

# Category codes, group labels, header openings and edition marks of the published lists.
CODES = ("CR", "EN", "VU", "NT", "LC", "DD", "RE", "EW", "EX", "NA", "NE")
LABELS = ("연체동물", "거미", "관속식물", "곤충1", "곤충2", "곤충3", "조류", "어류", "포유류", "파충류", "양서류")
HEADERS = ("분류군", "초판", "개정판", "범주", "현황", "페이지", "평가범주", "평가기준", "찾아보기", "4. 찾아보기")
BASE_EDITION, NEW_EDITION, NEW_GROUP = "2024(통합본)", "2025(곤충IV)", "곤충4"

_SPACE = r"(?U)\s+"
_GLUED = r"([a-z0-9\)\],])(" + "|".join(CODES) + r")\b"
_PUNCTUATION = ".,;:()[]"


def split_labels() -> dict[str, dict[str, str]]:
    """Beginning of a label (two letters or more) → {rest of the label: label}."""
    out: dict[str, dict[str, str]] = {}
    for label in LABELS:
        for cut in range(2, len(label)):
            out.setdefault(label[:cut], {})[label[cut:]] = label
    return out


def tokens(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, _SPACE, " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def unglue(text: Column) -> Column:
    """Set a space before a code stuck to the text before it."""
    return F.regexp_replace(text, _GLUED, "$1 $2")


def _joined_label(head: Column, line: Column) -> Column:
    """The line that a beginning of a label and its successor make together, NULL if they do not."""
    out = F.lit(None).cast("string")
    for start, rests in split_labels().items():
        for rest, label in rests.items():
            tail = F.regexp_replace(F.substring(line, len(rest) + 1, 2**31 - 1), r"^[ ?]+", "")
            out = F.when((F.trim(head) == start) & line.startswith(rest), F.concat(F.lit(f"{label} "), tail)).otherwise(out)
    return out


def repair_split_label(lines: DataFrame, width: int = CHUNK) -> DataFrame:
    """Rejoin labels cut across two lines of (doc, line_no, line), line_no being consecutive.

    Only lines that are nothing but the beginning of a label are joined with their successor. Lines are moved once, in
    chunks of line numbers; the first and last line of a chunk also visit the chunk beside them.
    """
    chunk, place = F.floor(F.col("line_no") / width), F.pmod(F.col("line_no"), F.lit(width))
    visits = F.array(
        F.struct(chunk.alias("chunk"), F.lit(False).alias("visits")),
        F.when(place == 0, F.struct((chunk - 1).alias("chunk"), F.lit(True).alias("visits"))),
        F.when(place == width - 1, F.struct((chunk + 1).alias("chunk"), F.lit(True).alias("visits"))),
    )
    rows = lines.select("doc", "line_no", "line", F.inline(F.array_compact(visits)))
    order = Window.partitionBy("doc", "chunk").orderBy("line_no")
    here = F.struct("line_no", "line")
    seen = rows.withColumns({"_next": F.lead(here).over(order), "_last": F.lag(here).over(order)})
    fixed = F.when(F.col("_next.line_no") == F.col("line_no") + 1, _joined_label(F.col("line"), F.col("_next.line")))
    taken = F.when(F.col("_last.line_no") == F.col("line_no") - 1, _joined_label(F.col("_last.line"), F.col("line")))
    return seen.where(~F.col("visits") & taken.isNull()).select("doc", "line_no", F.coalesce(fixed, F.col("line")).alias("line"))


def is_header(line: Column) -> Column:
    out = line.contains("•") | line.startswith("=====")
    for head in HEADERS:
        out = out | line.startswith(head)
    return out


def starts_record(line: Column) -> Column:
    return F.coalesce(F.get(tokens(line), F.lit(0)).isin(*LABELS), F.lit(False))


def unwrap_records(lines: DataFrame) -> DataFrame:
    """Lines → records (doc, start_no, record): a line opening with a label starts one, others continue it.

    The record a line belongs to is carried forward chunk by chunk, so a long document is no single task.
    """
    marked = _settled(lines, starts_record(F.col("line")).alias("_start"))
    owned = carry_forward(
        marked, ["doc"], "line_no", F.when(F.col("_start"), F.col("line_no")), "start_no"
    )
    kept = owned.where(F.col("start_no").isNotNull() & (F.col("_start") | ~is_header(F.col("line"))))
    pieces = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    return kept.groupBy("doc", "start_no").agg(F.array_join(pieces["line"], " ").alias("record"))


def _has_hangul(token: Column) -> Column:
    return token.rlike("[가-힣]") & ~token.rlike("^[A-Za-z]")


def _code_of(token: Column) -> Column:
    return F.btrim(token, F.lit(_PUNCTUATION))


def _first_true(flags: Column, otherwise: Column) -> Column:
    """1-based position of the first true flag."""
    return F.coalesce(F.nullif(F.array_position(flags, F.lit(True)), F.lit(0)), otherwise)


def _settled(df: DataFrame, *columns: Column) -> DataFrame:
    """Add columns through a generator, so that a later filter on them is not copied below their parts."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def _name_fields(df: DataFrame, first: int) -> DataFrame:
    """Add kor_name, sci_name and codes for token arrays whose vernacular starts at 1-based position `first`."""
    df = df.withColumn("_rest", F.slice("toks", first, F.greatest(F.size("toks"), F.lit(1))))
    after_kor = _first_true(F.transform("_rest", lambda t: ~_has_hangul(t)), F.size("_rest") + 1)
    df = df.withColumn("_i", after_kor.cast("int"))
    df = df.withColumn("_tail", F.slice("_rest", F.col("_i"), F.greatest(F.size("_rest"), F.lit(1))))
    df = df.withColumn("_bare", F.transform("_tail", _code_of))
    code_at = _first_true(F.transform("_bare", lambda t: t.isin(*CODES)), F.size("_bare") + 1)
    df = df.withColumn("_j", code_at.cast("int"))
    return _settled(
        df,
        F.array_join(F.slice("_rest", F.lit(1), F.col("_i") - 1), " ").alias("kor_name"),
        F.array_join(F.slice("_tail", F.lit(1), F.col("_j") - 1), " ").alias("sci_name"),
        F.filter("_bare", lambda t: t.isin(*CODES)).alias("codes"),
    ).drop("_rest", "_i", "_tail", "_bare", "_j")


def tagged_records(records: DataFrame) -> DataFrame:
    """Records with their fields and `reason`: NULL when they parse, else why they do not."""
    toks = _settled(records, tokens(unglue(F.col("record"))).alias("toks"))
    fields = _name_fields(toks, 2)
    data = (F.size("toks") >= 4) & F.coalesce(F.get("toks", F.lit(0)).isin(*LABELS), F.lit(False))
    reason = (
        F.when(~data, "not_data")
        .when(F.col("sci_name") == "", "no_sci")
        .when(F.size("codes") == 0, "no_code")
    )
    return fields.withColumn("reason", reason)


def parse_records(records: DataFrame) -> DataFrame:
    """(group, sci_name, kor_name, code) of every record that parses; the last code counts."""
    ok = tagged_records(records).where("reason IS NULL")
    return ok.select(
        "doc", F.col("start_no").alias("_ord"), F.get("toks", F.lit(0)).alias("group_label"), "sci_name",
        "kor_name", F.element_at("codes", -1).alias("code"), F.lit(BASE_EDITION).alias("source_year"),
    )


def parse_failures(records: DataFrame) -> DataFrame:
    """Records that open with a label but yield no row, with the reason."""
    started = records.where(starts_record(F.col("record")))
    return tagged_records(started).where("reason IS NOT NULL").select("doc", "start_no", "reason", "record")


def parse_insect_lines(lines: DataFrame) -> DataFrame:
    """(sci_name, kor_name, code) of lines that open in Hangul and end in a page number; the first code counts."""
    toks = _settled(lines, tokens(unglue(F.col("line"))).alias("toks"))
    shaped = toks.where(
        (F.size("toks") >= 3)
        & F.element_at("toks", -1).rlike(r"^-*\d+$")
        & _has_hangul(F.get("toks", F.lit(0)))
    )
    fields = _name_fields(shaped, 1).where("kor_name <> '' AND sci_name <> '' AND size(codes) > 0")
    return fields.select(
        "doc", F.col("line_no").alias("_ord"), "sci_name", "kor_name", F.get("codes", F.lit(0)).alias("code")
    )


def _short_key(sci: Column) -> Column:
    return F.array_join(F.slice(names.listed_words(sci), 1, 2), " ")


def merge_editions(base: DataFrame, newer: DataFrame) -> DataFrame:
    """Newer rows update the row with their name, else their vernacular; others are appended.

    Of rows sharing a key the last one is the target; of updates to one target the last one wins.
    """
    b = base.select(
        "_ord", "group_label", "sci_name", "kor_name", "code", "source_year",
        _short_key(F.col("sci_name")).alias("_sci"), names.vernacular_key(F.col("kor_name")).alias("_kor"),
    )
    n = newer.select(
        F.col("_ord").alias("_new"), "sci_name", "kor_name", "code",
        _short_key(F.col("sci_name")).alias("_sci"), names.vernacular_key(F.col("kor_name")).alias("_kor"),
    )
    by_sci = b.where("_sci <> ''").groupBy("_sci").agg(F.max("_ord").alias("_t_sci"))
    by_kor = b.where("_kor <> ''").groupBy("_kor").agg(F.max("_ord").alias("_t_kor"))
    aimed = spread_join(spread_join(n, by_sci, ["_sci"], ["_new"]), by_kor, ["_kor"], ["_new"]).withColumn(
        "_target", F.coalesce("_t_sci", "_t_kor")
    )
    updates = (
        aimed.where("_target IS NOT NULL")
        .groupBy(F.col("_target").alias("_ord"))
        .agg(F.max_by("code", "_new").alias("_code"))
    )
    updated = b.join(updates, "_ord", "left").select(
        "group_label", "sci_name", "kor_name", F.coalesce("_code", "code").alias("code"),
        F.when(F.col("_code").isNotNull(), NEW_EDITION).otherwise(F.col("source_year")).alias("source_year"),
    )
    appended = aimed.where("_target IS NULL").select(
        F.lit(NEW_GROUP).alias("group_label"), "sci_name", "kor_name", "code",
        F.lit(NEW_EDITION).alias("source_year"),
    )
    return updated.unionByName(appended)


def match_checklist(rated: DataFrame, raw: DataFrame) -> DataFrame:
    """Red list × raw checklist records: trinomial first, then binomial; accepted records first.

    Candidates are reduced to one pick and a count per key before the join.
    """
    g, s = F.lower(F.trim(F.coalesce("gnus", F.lit("")))), F.lower(F.trim(F.coalesce("specs", F.lit(""))))
    ss, v = F.lower(F.trim(F.coalesce("sspecs", F.lit("")))), F.lower(F.trim(F.coalesce("vrty", F.lit(""))))
    full = (g != "") & (s != "")
    binom = F.when(full, F.concat_ws(" ", g, s)).otherwise(names.listed_key(F.col("stnm"), 2))

    def tri(third: Column) -> Column:
        return F.when(full & (third != ""), F.struct(F.lit("t").alias("kind"), F.concat_ws(" ", g, s, third).alias("key")))

    keyed = raw.select(
        "ktsn", "stnm", "krn", "corsyn", "_ord",
        F.explode(F.array_compact(F.array(
            F.when(binom.isNotNull(), F.struct(F.lit("b").alias("kind"), binom.alias("key"))), tri(ss), tri(v)
        ))).alias("k"),
    )
    rec = F.struct("ktsn", "stnm", "krn", "corsyn")
    picks = keyed.groupBy("k").agg(
        F.min_by(rec, F.struct((F.coalesce("corsyn", F.lit("")) != "Y").alias("late"), F.col("_ord"))).alias("rec"),
        F.count(F.lit(1)).alias("n"),
    )

    def side(kind: str, key: str) -> DataFrame:
        return picks.where(F.col("k.kind") == kind).select(
            F.col("k.key").alias(key), F.col("rec").alias(f"{key}_rec"), F.col("n").alias(f"{key}_n")
        )

    # Names without a key are '' rather than NULL with no partner on the other side.
    r = rated.withColumn("_t", F.coalesce(names.listed_key(F.col("sci_name"), 3), F.lit(""))).withColumn(
        "_b", F.coalesce(names.listed_key(F.col("sci_name"), 2), F.lit(""))
    )
    spread_on = rated.columns
    joined = spread_join(spread_join(r, side("t", "_t"), ["_t"], spread_on), side("b", "_b"), ["_b"], spread_on)
    by_tri = F.col("_t_rec").isNotNull()
    rec = F.coalesce("_t_rec", "_b_rec")
    return joined.select(
        *rated.columns, rec["ktsn"].alias("ktsn"), rec["stnm"].alias("ktsn_stnm"), rec["krn"].alias("ktsn_kor"),
        rec["corsyn"].alias("ktsn_accepted"),
        F.when(by_tri, "trinomial").when(F.col("_b_rec").isNotNull(), "binomial").otherwise("none").alias("match_type"),
        F.coalesce("_t_n", "_b_n", F.lit(0)).alias("n_candidates"),
    )


def match_rates(matched: DataFrame, by: str) -> DataFrame:
    """Matched rows, unmatched rows and rate per group."""
    hit = F.col("ktsn").isNotNull()
    return matched.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(hit).alias("n_matched"), F.count_if(~hit).alias("n_unmatched"),
        F.bround(F.count_if(hit) * 100.0 / F.count(F.lit(1)), 1).alias("match_rate"),
    )
