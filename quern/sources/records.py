"""Records in lines, archives and status files: read strictly, every refusal with its reason."""

from __future__ import annotations

import io
import json
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.generated import json_fault
from quern.sources.shipping import ship


KINDS = {bool: "bool", int: "int", float: "float", str: "str", type(None): "null", dict: "dict", list: "list"}
SAMPLES, SAMPLE_LENGTH = 20, 60


def walked(value: object, at: str, keys: Counter, leaves: Counter, lengths: dict, samples: dict, marks: Counter, words: tuple[str, ...]) -> None:
    """Counts of a JSON value: every key's path, leaf types by path, lengths of lists, sample values, and keys that hold one of ``words``.

    Elements of a list share the path of the list and ``[]``.
    """
    if isinstance(value, dict):
        for k, v in value.items():
            path = f"{at}.{k}" if at else str(k)
            keys[path] += 1
            if any(w in str(k).lower() for w in words):
                marks[path] += 1
            walked(v, path, keys, leaves, lengths, samples, marks, words)
    elif isinstance(value, list):
        n, lo, hi = lengths.get(at + "[]", (0, len(value), len(value)))
        lengths[at + "[]"] = n + 1, min(lo, len(value)), max(hi, len(value))
        for v in value:
            walked(v, at + "[]", keys, leaves, lengths, samples, marks, words)
    else:
        leaves[at, KINDS[type(value)]] += 1
        held = samples.setdefault(at, set())
        held.add(str(value)[:SAMPLE_LENGTH])
        if len(held) > SAMPLES:
            held.remove(max(held))


def census(df: DataFrame, json_col: str, words: tuple[str, ...] = ()) -> DataFrame:
    """(what, path, kind, n, least, most, samples) of a JSON column over any depth: what is key, leaf (kind: its type), list (its lengths),
    mark (keys that hold a word) or broken (texts that are no JSON, path null).

    samples: the least SAMPLES different values of a leaf, cut to SAMPLE_LENGTH.  Counted in each partition first.
    """
    ship()
    schema = "what string, path string, kind string, n long, least int, most int, samples array<string>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, leaves, lengths, samples, marks, broken = Counter(), Counter(), {}, {}, Counter(), 0
        for batch in batches:
            for text in batch.iloc[:, 0]:
                try:
                    value = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    broken += 1
                    continue
                walked(value, "", keys, leaves, lengths, samples, marks, words)
        first: set = set()
        out = [("key", p, None, n, None, None, None) for p, n in keys.items()] + [("mark", p, None, n, None, None, None) for p, n in marks.items()]
        out += [("list", p, None, n, lo, hi, None) for p, (n, lo, hi) in lengths.items()] + ([("broken", None, None, broken, None, None, None)] if broken else [])
        for (p, kind), n in leaves.items():
            out.append(("leaf", p, kind, n, None, None, None if p in first else sorted(samples[p])))
            first.add(p)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"least": "Int32", "most": "Int32"})

    parts = df.select(F.col(json_col).cast("string").alias("j")).mapInPandas(run, schema)
    every = parts.groupBy("what", "path").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, SAMPLES).alias("samples"))
    g = parts.groupBy("what", "path", "kind").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    same = F.col("g.path").eqNullSafe(F.col("e.path")) & (F.col("g.what") == F.col("e.what"))
    return g.alias("g").join(every.alias("e"), same).select("g.what", "g.path", "kind", "n", "least", "most", F.when(F.col("g.what") == "leaf", F.col("samples")).alias("samples"))


def zip_records(spark: SparkSession, path: str, schema: str, suffix: str = ".json") -> DataFrame:
    """(archive, member, fault, text) of the members of zip files, not unpacked to disk; a member that is no UTF-8 JSON object (a byte order mark
    is allowed) has a fault and no text.  ``schema`` is that of F.from_json(text, schema) later; it is checked here to be one."""
    ship()
    spark.range(0).select(F.from_json(F.lit("{}"), schema))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if n.lower().endswith(suffix)):
                        try:
                            text = z.read(member).decode("utf-8-sig")
                            fault = None if isinstance(json.loads(text), dict) else "no object"
                        except (ValueError, RecursionError):
                            text, fault = None, "unreadable"
                        out.append((name.rpartition("/")[2], member, fault, None if fault else text))
                yield pd.DataFrame(out, columns=["archive", "member", "fault", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    if files.isEmpty():
        raise ValueError(f"no archive in {path}")
    return files.mapInPandas(run, "archive string, member string, fault string, text string")


def strict_jsonl(spark: SparkSession, path: str, schema: str, blank_ok: bool = True) -> DataFrame:
    """JSON lines of a schema; a line with a key twice, a constant (NaN, Infinity) or no object is an error, a blank one too unless they are let pass."""
    lines = spark.read.text(path)
    lines = lines.where(F.trim("value") != "") if blank_ok else lines
    fault = json_fault(F.col("value"))
    ok = F.assert_true(fault.isNull(), "a line that is refused").isNull()
    return lines.where(ok).select(F.from_json("value", schema).alias("r")).select("r.*")


def csv_rows(lines: DataFrame, types: dict[str, str], key: str, number: str = "n", text: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows, faults) of CSV lines (n, line): rows typed, with their number; faults (n, fault, field): ragged lines, fields that cannot be read as their
    type, and repeated keys (all but the first line of a key).  Nothing stops at the first fault."""
    names = list(types)
    schema = ", ".join(f"`{c}` string" for c in names) + ", _bad string"
    parsed = lines.select(number, F.from_csv(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'}).alias("r")).select(number, "r.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    cast = lambda c, k: F.when(blank(c) != "", F.when(blank(c).isin("True", "true"), True).when(blank(c).isin("False", "false"), False) if k == "boolean" else blank(c).try_cast(k))
    whole = parsed.where("_bad is null")
    made = whole.select(number, *[(blank(c) if k == "string" else cast(c, k)).alias(c) for c, k in types.items()], *[((blank(c) != "") & cast(c, k).isNull()).alias(f"_{c}") for c, k in types.items() if k != "string"])
    checked = [c for c, k in types.items() if k != "string"]
    bad = F.array_compact(F.array(*[F.when(F.col(f"_{c}"), F.lit(c)) for c in checked])) if checked else F.array().cast("array<string>")
    unread = made.select(number, F.lit("unreadable").alias("fault"), F.explode(bad).alias("field"))
    ragged = parsed.where("_bad is not null").select(number, F.lit("ragged").alias("fault"), F.lit(None).cast("string").alias("field"))
    first = made.groupBy(key).agg(F.min(number).alias("_first"))
    twice = made.join(first, key).where(F.col(number) > F.col("_first")).select(number, F.lit("repeated").alias("fault"), F.lit(key).alias("field"))
    faults = ragged.union(unread).union(twice)
    return made.join(faults.select(number).distinct(), number, "left_anti").select(number, *names), faults


#: A prediction of either version, as text; what the versions need.
VERSIONS = {"1.3": ("image_id", "cell", "seed", "parse_ok"), "1.4": ("image_id", "cell", "seed", "parse_ok", "gen_stop", "n_new_tokens", "coord_space")}


def prediction_faults(lines: DataFrame, key: str, text: str) -> DataFrame:
    """(key, version, fault) of prediction lines: blank, no_object, version (an unknown one), missing:<field>, else null."""
    t = F.coalesce(F.col(text), F.lit(""))
    keys = F.json_object_keys(t)
    version = F.get_json_object(t, "$.schema_version")
    missing = F.lit(None).cast("string")
    for v, fields in VERSIONS.items():
        lost = F.array_except(F.array(*[F.lit(f) for f in fields]), F.coalesce(keys, F.array().cast("array<string>")))
        missing = F.when((version == v) & (F.size(lost) > 0), F.concat(F.lit("missing:"), F.get(lost, F.lit(0)))).otherwise(missing)
    fault = F.when(F.trim(t) == "", "blank").when(keys.isNull(), "no_object").when(~F.coalesce(version.isin(list(VERSIONS)), F.lit(False)), "version").otherwise(missing)
    return lines.select(key, version.alias("version"), fault.alias("fault"))


def one_version(lines: DataFrame, key: str, text: str) -> str:
    """The version of prediction lines of one only; a fault, several or no lines are errors."""
    f = prediction_faults(lines, key, text)
    if bad := f.where("fault is not null").first():
        raise ValueError(f"{bad[key]}: {bad['fault']}")
    found = [r[0] for r in f.select("version").distinct().collect()]
    if len(found) != 1:
        raise ValueError(f"versions {sorted(found)}")
    return found[0]


def list_fault(content: Column) -> Column:
    """Why bytes are no canonical list of ids, or null: bom, cr, empty, no_newline, utf8, blank (a line that is empty or has blanks at its ends), twice."""
    hexes = F.hex(content)
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    lines = F.split(F.substr(text, F.lit(1), F.length(text) - 1), "\n")
    has_cr = F.contains(F.concat(F.lit(","), F.regexp_replace(hexes, "(..)", "$1,")), F.lit(",0D,"))
    return (
        F.when(hexes.startswith("EFBBBF"), "bom").when(has_cr, "cr").when(F.length(content) == 0, "empty").when(~hexes.endswith("0A"), "no_newline").when(text.isNull(), "utf8")
        .when(F.exists(lines, lambda x: (x == "") | (x != F.trim(x))), "blank").when(F.size(F.array_distinct(lines)) != F.size(lines), "twice")
    )


def list_digests(content: Column) -> Column:
    """struct(file_sha256, set_sha256) of a canonical list: of its bytes, and of its sorted ids, a line each."""
    text = content.cast("string")
    ids = F.array_sort(F.split(F.substr(text, F.lit(1), F.length(text) - 1), "\n"))
    return F.struct(F.sha2(content, 256).alias("file_sha256"), F.sha2(F.concat(F.array_join(ids, "\n"), F.lit("\n")).cast("binary"), 256).alias("set_sha256"))


def result_rows(lines: DataFrame, header: list[str], number: str = "n", text: str = "line") -> DataFrame:
    """(n, values: map, state) of result lines of a header whose first column is epoch: ok; remapped (an older, short row of the columns before the
    first ``metrics/`` or ``val/`` and from the first ``lr/`` on); long, short (no such row) or epoch (no number) for rows that are dropped."""
    cells = F.transform(F.split(F.regexp_replace(F.col(text), "^﻿", ""), ",", -1), lambda x: F.trim(x))
    mid = next((i for i, h in enumerate(header) if h.startswith(("metrics/", "val/"))), None)
    tail = next((i for i, h in enumerate(header) if h.startswith("lr/")), None)
    n = len(header)
    old = mid + n - tail if mid is not None and tail is not None and tail > mid else -1
    filled = F.concat(F.slice(cells, 1, mid), F.array_repeat(F.lit(""), tail - mid), F.slice(cells, mid + 1, n - tail)) if old > 0 else cells
    state = F.when(F.size(cells) > n, "long").when(F.size(cells) == n, "ok").when(F.size(cells) == old, "remapped").otherwise("short")
    rows = lines.where(F.trim(F.regexp_replace(F.col(text), ",", "")) != "").select(number, F.when(state == "remapped", filled).otherwise(cells).alias("c"), state.alias("state"))
    epoch = F.get("c", F.lit(0)).try_cast("double")
    value = lambda i: F.get("c", F.lit(i)).try_cast("double")
    made = F.map_from_arrays(F.array(*[F.lit(h) for h in header]), F.array(*[value(i) for i in range(n)]))
    final = F.when(F.col("state").isin("ok", "remapped") & epoch.isNull(), "epoch").otherwise(F.col("state"))
    return rows.select(number, F.when(final.isin("ok", "remapped"), made).alias("values"), final.alias("state"))


def live_status(text: Column, now: Column, run_id: str, identity: str, total: int, shard: int = 64, stale_after: int = 120) -> Column:
    """struct(available, stale, age, reason) of a status text: another run, a time without offset or ahead of now, counts out of bounds, rows that are not
    those of their shards, or parts that do not add up make it unavailable."""
    at = lambda f: F.get_json_object(text, f"$.{f}")
    stamp = at("observed_at_utc")
    zoned = stamp.rlike(r"(Z|[+\-]\d\d:\d\d)$")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp(stamp))
    number = lambda f: at(f).try_cast("long")
    shards = -(-total // shard)
    top = {"generated_shards": shards, "judged_shards": shards, "generated_rows": total, "judged_rows": total, "pending_judge_rows": total}
    wrong = F.lit(False)
    for f, most in top.items():
        wrong |= F.coalesce((at(f).isNotNull() & number(f).isNull()) | (number(f) < 0) | (number(f) > most), F.lit(False))
    rows = F.lit(False)
    for s in ("generated", "judged"):
        rows |= F.coalesce(number(f"{s}_rows") != F.least(number(f"{s}_shards") * shard, F.lit(total)), F.lit(False))
    parts = F.coalesce(number("judged_rows") + number("pending_judge_rows") != total, F.lit(False))
    reason = (
        F.when(F.length(text) > 1_000_000, "size").when(F.json_object_keys(text).isNull(), "no_object").when(~F.coalesce((at("run_id") == run_id) & (at("identity") == identity), F.lit(False)), "run")
        .when(~F.coalesce(zoned & (age >= -30), F.lit(False)), "time").when(wrong, "count").when(rows, "rows").when(parts, "pending")
    )
    good = reason.isNull()
    return F.struct(good.alias("available"), (~good | (age > stale_after)).alias("stale"), F.when(good, F.greatest(age, F.lit(0))).alias("age"), reason.alias("reason"))


def event_view(event: Column, messages: dict[str, str]) -> Column:
    """struct of the few short fields of an event object that may be shown, with fallbacks; a reason of other than plain signs is not."""
    at = lambda *f: F.coalesce(*[F.get_json_object(event, f"$.{x}") for x in f], F.lit(None).cast("string"))
    short = lambda c, n: F.substr(F.coalesce(c, F.lit("")), F.lit(1), F.lit(n))
    number = lambda c: F.when(F.abs(c.try_cast("double")) < 1e12, c.try_cast("double"))
    reason = F.coalesce(at("reason"), F.lit(""))
    said = F.create_map(*[F.lit(x) for kv in messages.items() for x in kv])
    return F.struct(
        short(at("at", "observed_at_utc"), 50).alias("at"), short(at("event"), 70).alias("event"), short(at("stage"), 20).alias("stage"), F.when(reason.rlike("^[a-zA-Z0-9_ :.-]*$"), short(reason, 100)).otherwise("details_redacted").alias("reason"),
        number(at("counts.generate", "snapshot.generate")).alias("generated_shards"), number(at("counts.judge", "snapshot.judge", "shards")).alias("judged_shards"), F.coalesce(F.element_at(said, at("event")), F.lit("")).alias("message"),
        number(at("outer_rc", "external_rc", "rc")).alias("external_rc"), number(at("cost_estimate_won", "cost_won")).alias("cost"), number(at("report.projected_won")).alias("projected"),
    )


def prediction_lines(predictions: DataFrame, order: DataFrame, unit: str) -> DataFrame:
    """(place, line): one JSON line for each unit of ``order`` (unit, place), units without predictions with an empty list.

    predictions: (unit, code, x1, y1, x2, y2); boxes of a unit by code and corners."""
    box = F.struct("code", F.array("x1", "y1", "x2", "y2").alias("box"))
    g = predictions.groupBy(unit).agg(F.array_sort(F.collect_list(box)).alias("defects"))
    j = order.join(g, unit, "left")
    none = F.array().cast(g.schema["defects"].dataType)
    return j.select("place", F.to_json(F.struct(F.col(unit).alias("image_id"), F.coalesce("defects", none).alias("defects"))).alias("line"))


def side_faults(lines: DataFrame, ids: DataFrame, number: str = "n", text: str = "line") -> DataFrame:
    """(n, fault) of a side file's lines (n from 1, header first) against the list (n from 1, id): header, fields, integer (a size that is no plain whole
    number), size (not 1 <= n_h <= G_h), stratum (sizes that differ within one), twice, order (another id than the list's at this place)."""
    parts = F.split(F.col(text), ",", -1)
    head = lines.where(F.col(number) == 1).where(F.col(text) != "image_id,stratum,G_h,n_h").select(number, F.lit("header").alias("fault"))
    body = lines.where(F.col(number) > 1).select(number, parts.alias("p"))
    ragged = body.where(F.size("p") != 4).select(number, F.lit("fields").alias("fault"))
    plain = r"^(0|[1-9][0-9]*)$"
    four = body.where(F.size("p") == 4).select(number, *[F.get("p", F.lit(i)).alias(c) for i, c in enumerate(("image_id", "stratum", "g", "k"))])
    bad = ~(F.col("g").rlike(plain) & F.col("k").rlike(plain))
    whole = four.where(~bad).withColumn("G_h", F.col("g").cast("long")).withColumn("n_h", F.col("k").cast("long"))
    first = whole.groupBy("stratum").agg(F.min_by(F.struct("G_h", "n_h"), number).alias("s"))
    seen = four.groupBy("image_id").agg(F.min(number).alias("f"))
    place = ids.select((F.col("n") + 1).alias(number), F.col("id").alias("_id"))
    out = ragged.union(head).union(four.where(bad).select(number, F.lit("integer"))).union(whole.where((F.col("n_h") < 1) | (F.col("n_h") > F.col("G_h"))).select(number, F.lit("size")))
    out = out.union(whole.join(first, "stratum").where((F.col("G_h") != F.col("s.G_h")) | (F.col("n_h") != F.col("s.n_h"))).select(number, F.lit("stratum")))
    out = out.union(four.join(seen, "image_id").where(F.col(number) > F.col("f")).select(number, F.lit("twice")))
    return out.union(four.join(place, number, "full").where(~F.col("image_id").eqNullSafe(F.col("_id"))).select(number, F.lit("order")))
