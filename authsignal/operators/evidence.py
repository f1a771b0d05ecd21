"""Evidence from log lines and packets: parsing, identifiers, keyword counts, verdicts.

Where lines are picked from a time on, the time is ``ts``. ``logtime.with_line_times`` gives one to
lines that carry none; without it they don't count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authsignal.config import DetectorConfig
from authsignal.functions.columns import carries, occurrences
from authsignal.operators.features import null_scheme_field
from authsignal.operators.filters import last_n

# ---- fixed values: shapes of the four text formats ----
ANSI = "\x1b\\[[0-9;]*m"
AMF_LINE = r"^(\d\d/\d\d \d\d:\d\d:\d\d\.\d{3}): \[([^\]]+)\] ([A-Z]+): (.*) \(([^()]+:\d+)\)$"
SIMULATOR_LINE = r"^\[(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{3})\] \[([^\]]+)\] \[([^\]]+)\] (.*)$"
SUMMARY_LINE = r"^\s*(\d+)\s+(\d+\.\d+)\s+(\S+) → (\S+)\s+(\S+) (\d+) (.*)$"
DUMP_LINE = r"^(\d\d:\d\d:\d\d\.\d{6}) IP (\S+)\.(\d+) > (\S+)\.(\d+): sctp \(1\) \[([A-Z ]+)\].*$"
HEX_RAND = "^[0-9a-f]{32}$"


SEPARATOR = "\x01"


def _fields(
    lines: DataFrame, text: Column, pattern: str, columns: dict[str, str], otherwise: dict[str, Column] | None = None
) -> DataFrame:
    """Match each line once and turn its groups into columns.

    Lines that do not match are dropped, or, with ``otherwise``, kept with these values and nulls.
    One replacement writes all groups side by side, one split takes them apart; only a line that
    itself holds the separator is taken apart group by group. Going through a generator keeps that
    work in a single place: a filter on the parts would be pushed below the projection and match
    every line a second time.
    """
    groups = SEPARATOR.join(f"${i + 1}" for i in range(len(columns)))
    parts = F.split(F.regexp_replace(text, pattern, groups), SEPARATOR)
    one_by_one = F.when(text.rlike(pattern), F.array(*[F.regexp_extract(text, pattern, i + 1) for i in range(len(columns))]))
    parts = F.when(F.contains(text, F.lit(SEPARATOR)), one_by_one).otherwise(parts)
    row = F.struct(*[F.expr(sql.replace("{}", f"_parts[{i}]")).alias(name) for i, (name, sql) in enumerate(columns.items())])
    kept = [c for c in lines.columns if c != "line"]
    matched = F.when(F.coalesce(F.size("_parts"), F.lit(0)) == len(columns), F.array(row))
    if otherwise is not None:
        spare = [otherwise.get(name, F.expr(f"CAST(NULL AS {sql.split(' AS ')[1][:-1] if ' AS ' in sql else 'string'})")).alias(name) for name, sql in columns.items()]
        matched = matched.otherwise(F.array(F.struct(*spare)))
    return lines.withColumn("_parts", parts).select(*kept, F.inline(matched))


def plain(line: Column) -> Column:
    """The line without terminal colours."""
    return F.regexp_replace(line, ANSI, "")


def parse_amf(lines: DataFrame, year: int | Column) -> DataFrame:
    """AMF log lines into stamp, time, module, level, message and place.

    The lines carry no year, so the caller gives one, or a column where a log crosses New Year. A
    line of another shape keeps its text as the message, with ``parsed`` false and no time; a stamp
    that is no date in its year leaves the time null.
    """
    columns = {name: "{}" for name in ("stamp", "module", "level", "message", "place")}
    if isinstance(year, Column):
        lines, year = lines.withColumn("_year", year), F.col("_year")
    else:
        year = F.lit(year)
    text = plain(F.col("line"))
    rows = _fields(lines.withColumn("_text", text), F.col("_text"), AMF_LINE, columns, {"message": F.col("_text")})
    stamp = F.concat(year.cast("string"), F.lit("/"), "stamp")
    return (
        rows.withColumn("parsed", F.col("stamp").isNotNull())
        .withColumn("ts", F.try_to_timestamp(stamp, F.lit("yyyy/MM/dd HH:mm:ss.SSS")))
        .drop("_text", "_year")
    )


def parse_simulator(lines: DataFrame) -> DataFrame:
    """Simulator lines; a line of another shape keeps its text as the message, with ``parsed`` false."""
    columns = {name: "{}" for name in ("stamp", "module", "level", "message")}
    rows = _fields(lines.withColumn("_text", plain(F.col("line"))), F.col("_text"), SIMULATOR_LINE, columns, {"message": F.col("_text")})
    return (
        rows.withColumn("parsed", F.col("stamp").isNotNull())
        .withColumn("ts", F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss.SSS")))
        .drop("stamp", "_text")
    )


def parse_summary(lines: DataFrame) -> DataFrame:
    """Packet-summary lines into their columns; a line of another shape keeps its text as ``info``."""
    columns = {
        "frame_no": "try_cast({} AS bigint)",
        "seconds": "try_cast({} AS double)",
        "src_ip": "{}",
        "dst_ip": "{}",
        "protocol": "{}",
        "length": "try_cast({} AS int)",
        "info": "{}",
    }
    rows = _fields(lines.withColumn("_text", F.col("line")), F.col("_text"), SUMMARY_LINE, columns, {"info": F.col("_text")})
    return rows.withColumn("parsed", F.col("protocol").isNotNull()).drop("_text")


def parse_dump(lines: DataFrame) -> DataFrame:
    """Packet-dump lines into time, ends and chunk name; a line of another shape is kept as ``rest``."""
    columns = {
        "time": "{}",
        "src_ip": "{}",
        "src_port": "try_cast({} AS int)",
        "dst_ip": "{}",
        "dst_port": "try_cast({} AS int)",
        "chunk": "{}",
    }
    rows = _fields(lines.withColumn("_text", F.col("line")), F.col("_text"), DUMP_LINE, columns, {})
    parsed = F.col("time").isNotNull()
    return rows.withColumn("parsed", parsed).withColumn("rest", F.when(~parsed, F.col("_text"))).drop("_text")


def _found(name: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def with_identifiers(parsed: DataFrame) -> DataFrame:
    """Subscriber, scheme, reject cause and base-station address named in a message."""
    return (
        parsed.withColumn("suci", _found("message", r"\[(suci-[^\]]+)\]"))
        .withColumn("scheme", _found("message", r"suci-\d+-\d+-\d+-\d+-(\d)-").cast("int"))
        .withColumn("imsi", _found("message", r"(imsi-\d{15})"))
        .withColumn("cause", _found("message", r"reject \[(\d+)\]").try_cast("int"))
        .withColumn("gnb_ip", _found("message", r"gNB-N2(?: accepted)?\[([0-9.]+)\]"))
    )


def matching(parsed: DataFrame, pattern: str, since: Column | None = None) -> DataFrame:
    """Lines matching a pattern, optionally from a time on."""
    hit = F.col("message").rlike(pattern)
    return parsed.where(hit if since is None else (F.col("ts") >= since) & hit)


def keyword_counts(parsed: DataFrame, keywords: dict[str, str], since: Column, by: str) -> DataFrame:
    """Lines per group that contain each keyword, from a time on."""
    return (
        parsed.where(F.col("ts") >= since)
        .groupBy(by)
        .agg(*[F.count_if(F.contains(F.col("message"), F.lit(word))).alias(name) for name, word in keywords.items()])
    )


def keyword_occurrences(texts: DataFrame, text: str, keywords: dict[str, str], by: str) -> DataFrame:
    """Occurrences (not lines) of each keyword in case-folded whole texts, summed per group."""
    folded = F.lower(F.col(text))
    return texts.groupBy(by).agg(
        *[F.sum(F.coalesce(occurrences(folded, word.lower()), F.lit(0))).alias(name) for name, word in keywords.items()]
    )


def recent_failures(parsed: DataFrame, by: str, order: str, n: int = 20) -> DataFrame:
    """Authentication failures among the last ``n`` failure or reject lines of each source."""
    lines = matching(parsed, "(?i)MAC failure|Authentication reject")
    return last_n(lines, by, order, n).groupBy(by).agg(
        F.sum(occurrences(F.col("message"), "MAC failure")).alias("failures"), F.count("*").alias("lines")
    )


def recent_lines(parsed: DataFrame, pattern: str, by: str, order: str, n: int = 5) -> DataFrame:
    """How many of the last ``n`` matching lines each source has, and the newest of them."""
    rows = last_n(matching(parsed, pattern), by, order, n)
    return rows.groupBy(by).agg(F.count("*").alias("lines"), F.max(order).alias("newest"))


def last_registrations(parsed: DataFrame, by: str, order: str, n: int = 4) -> DataFrame:
    return last_n(matching(parsed, "SUPI"), by, order, n)


def merged(from_packets: DataFrame, from_log: DataFrame) -> DataFrame:
    """One row per capture that either side has; what a side doesn't have counts as zero or false."""
    both = from_packets.unionByName(from_log, allowMissingColumns=True)
    values = [c for c in both.columns if c != "capture"]
    return both.groupBy("capture").agg(*[F.max(c).alias(c) for c in values]).na.fill(0).na.fill(False)


def _since(parsed: DataFrame, since: Column | None) -> DataFrame:
    return parsed if since is None else parsed.where(F.col("ts") >= since)


def failure_evidence(
    packets: DataFrame, parsed: DataFrame, cfg: DetectorConfig = DetectorConfig(), since: Column | None = None
) -> DataFrame:
    """Guessing: failures and rejects in the log (from a time on), packet counts, verdict from the log."""
    from_log = _since(parsed, since).groupBy("capture").agg(
        F.count_if(F.contains("message", F.lit("MAC failure"))).alias("log_failures"),
        F.count_if(F.contains("message", F.lit("Authentication reject"))).alias("log_rejects"),
    )
    from_packets = packets.groupBy("capture").agg(
        F.count("*").alias("packets"),
        F.count_if(F.col("protocol").rlike("(?i)sctp|ngap")).alias("sctp_packets"),
        F.count_if(carries("nas_msg_types", cfg.auth_failure)).alias("failure_packets"),
    )
    return merged(from_packets, from_log).withColumn("detected", F.col("log_failures") > 0)


def reject_evidence(packets: DataFrame, parsed: DataFrame, since: Column | None = None) -> DataFrame:
    """Bidding down: the word reject in packet summaries and log lines (from a time on)."""
    picked = F.coalesce(F.col("info").rlike("(?i)reject|security mode"), F.lit(False))
    from_packets = packets.groupBy("capture").agg(
        F.sum(F.when(picked, occurrences(F.lower("info"), "reject")).otherwise(0)).alias("packet_rejects")
    )
    logged = F.col("message").rlike("(?i)security|reject|algorithm")
    from_log = _since(parsed, since).groupBy("capture").agg(
        F.sum(F.when(logged, occurrences(F.lower("message"), "reject")).otherwise(0)).alias("log_rejects")
    )
    both = merged(from_packets, from_log)
    return both.withColumn("detected", F.col("packet_rejects") + F.col("log_rejects") > 0)


def null_scheme_evidence(packets: DataFrame, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Identity exposure: null scheme in dissected text, and as field value."""
    return packets.groupBy("capture").agg(
        F.sum(F.coalesce(occurrences(F.lower("info"), "null scheme"), F.lit(0))).alias("text_hits"),
        F.expr(f"count_if({null_scheme_field(cfg)})").alias("field_hits"),
        F.count("prot_scheme_id").alias("schemes_seen"),
    ).withColumn("detected", (F.col("text_hits") > 0) | (F.col("field_hits") > 0))


def rogue_evidence(
    packets: DataFrame, parsed: DataFrame, rogue_address: str, since: Column | None = None
) -> DataFrame:
    """False base station: set-up answers, refusals, acceptance of the address, authentications seen."""
    has = lambda col, word: F.max(F.coalesce(F.contains(F.col(col), F.lit(word)), F.lit(False)))
    from_packets = packets.groupBy("capture").agg(
        has("info", "NGSetupResponse").alias("setup_response"),
        has("info", "NGSetupFailure").alias("setup_failure"),
        has("info", "Authentication").alias("auth_seen"),
    )
    accepted = F.lower("message").contains("accepted") & F.col("message").contains(f"[{rogue_address}]")
    from_log = _since(parsed, since).groupBy("capture").agg(
        F.max(F.lower("message").contains("refused")).alias("refused"), F.max(accepted).alias("accepted")
    )
    return merged(from_packets, from_log).withColumn("detected", F.col("refused") | F.col("accepted"))


def abort_evidence(packets: DataFrame, rand: str = "rand") -> DataFrame:
    """Replay: an abort was sent; the first well-formed challenge of the capture.

    Picking a text value needs a sorted aggregation, so only the few packets with a well-formed
    challenge take part in it; the counts over all packets stay in a hash aggregation.
    """
    clean = F.lower(F.replace(F.col(rand), F.lit(":"), F.lit("")))
    challenges = packets.select("capture", "frame_no", clean.alias("clean")).where(F.col("clean").rlike(HEX_RAND))
    first = challenges.groupBy("capture").agg(F.min_by("clean", "frame_no").alias("first_rand"))
    seen = packets.groupBy("capture").agg(
        F.max(F.coalesce(F.contains("info", F.lit("ABORT")), F.lit(False))).alias("abort_seen"),
        F.count("*").alias("packets"),
    )
    return seen.join(first, "capture", "left").select("capture", "abort_seen", "first_rand", "packets")


def evidence_sections(packets: DataFrame, parsed: DataFrame) -> DataFrame:
    """Lines worth keeping per capture, by section.

    ``packets`` and ``scheme_lines`` are packet summaries, ``scheme_values`` the values of the scheme
    field; ``log`` and ``base_station`` are log lines.
    """
    from_packets = packets.where(F.col("info").rlike("(?i)reject|security mode|NGSetup|ABORT")).select(
        "capture", F.lit("packets").alias("section"), F.col("frame_no").alias("seq"), F.col("info").alias("line")
    )
    shown = lambda rows, section, seq, line: rows.select("capture", F.lit(section).alias("section"), F.col(seq).alias("seq"), line.alias("line"))
    parts = [
        from_packets,
        shown(packets.where(F.col("info").rlike("(?i)protection scheme")), "scheme_lines", "frame_no", F.col("info")),
        shown(packets.where(F.col("prot_scheme_id").isNotNull()), "scheme_values", "frame_no", F.col("prot_scheme_id").cast("string")),
        shown(matching(parsed, "(?i)security|reject|refused|accepted"), "log", "seq", F.col("message")),
        shown(matching(parsed, "gNB-N2"), "base_station", "seq", F.col("message")),
    ]
    return reduce(DataFrame.unionByName, parts)
