"""Readers of journal exports: CSV, JSON lines, one JSON or Markdown file per persona, unions of runs, packed arrays.

Files are parsed by Spark's own expressions, one row per file, so a folder of millions of files is read by all executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql import types as T

from pathwise.schema import DIMS, assert_columns

_SCORES = T.StructType([T.StructField(d, T.LongType()) for d in DIMS])
LABEL_FILE = T.StructType([
    T.StructField("persona_id", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StructType([
        T.StructField("t_index", T.LongType()), T.StructField("date", T.StringType()), T.StructField("scores", _SCORES),
        T.StructField("rationales", T.MapType(T.StringType(), T.StringType())), T.StructField("rationale", T.StringType()),
    ]))), T.StructField("_corrupt_record", T.StringType()),
])


def read_parquet(spark: SparkSession, *paths: str, schema=None, where: Column | str | None = None) -> DataFrame:
    """Parquet, with a filter that reaches the scan."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(*paths)
    return df if where is None else df.where(where)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a stated schema: nothing is inferred by an extra pass."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 1) and value of every line of text files. A line's number is its place in its split and the lines of the
    file's splits before: splits are counted, no file has to be read by one task."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), "value").withColumn("_id", F.monotonically_increasing_id())
    splits = rows.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_start")) - F.col("_n")
    splits = splits.select("file", "_start", (before - F.col("_first") + 1).alias("_shift"))
    return rows.join(splits, ["file", "_start"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def jsonl_problems(spark: SparkSession, path: str) -> DataFrame:
    """file, line and problem of the lines that are no JSON or no object; blank lines are none."""
    parsed = F.try_parse_json("value")
    problem = F.when(parsed.isNull(), "is not valid JSON").when(~F.schema_of_variant(parsed).startswith("OBJECT"), "must contain a JSON object")
    return numbered_lines(spark, path).where(F.trim("value") != "").select("file", "line", problem.alias("problem")).where("problem is not null")


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines, blank lines skipped. `strict`: ValueError that names file and line of the first one that is no JSON or no
    object, by a pass before the rows are read; else such lines go."""
    if strict:
        bad = jsonl_problems(spark, path).orderBy("file", "line").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0]['file']}:{bad[0]['line']} {bad[0]['problem']}")
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    full = f"{schema}, _corrupt_record string"
    rows = spark.read.schema(full).json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name), content: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("content"))


def persona_of(file: str = "file") -> Column:
    """The 8 hex digits of a file name, else its first digits; another name raises when it is read."""
    hexed, digits = F.regexp_extract(file, r"(?<![0-9a-f])([0-9a-f]{8})(?![0-9a-f])", 1), F.regexp_extract(file, r"(\d+)", 1)
    return F.when(hexed != "", hexed).when(digits != "", digits).otherwise(F.raise_error(F.concat(F.lit("no persona id in "), F.col(file))))


def read_label_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One JSON per persona: (labels, errors). A bad file is an error row and its labels are left out; ValueError if all are bad.

    A label of the old shape, with one `rationale`, gives it to each dimension that is not 0.
    """
    parsed = whole_files(spark, path).withColumn("j", F.from_json("content", LABEL_FILE, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    outside = F.exists("j.labels", lambda x: reduce(lambda a, d: a | F.coalesce(~x["scores"][d].between(-1, 1), F.lit(True)), DIMS, F.lit(False)))
    problem = F.when(F.col("j._corrupt_record").isNotNull() | F.col("j").isNull(), "malformed").when(F.col("j.persona_id").isNull(), "no persona_id").when(F.col("j.labels").isNull(), "no labels").when(outside, "score missing or out of range")
    checked = parsed.withColumn("problem", problem)
    errors = checked.where("problem is not null").select("file", "problem")
    good = checked.where("problem is null")
    if good.isEmpty() and not errors.isEmpty():
        raise ValueError("no label file can be read")
    rows = good.select(F.col("j.persona_id").alias("persona_id"), F.explode("j.labels").alias("x"))
    active = F.filter(F.array(*(F.struct(F.lit(d).alias("d"), F.col(f"x.scores.{d}").alias("s")) for d in DIMS)), lambda v: v["s"] != 0)
    spread = F.map_from_entries(F.transform(active, lambda v: F.struct(v["d"], F.col("x.rationale"))))
    why = F.coalesce("x.rationales", F.when(F.col("x.rationale").isNotNull(), spread))
    return rows.select("persona_id", "x.t_index", "x.date", *(F.col(f"x.scores.{d}").alias(f"alignment_{d}") for d in DIMS), F.array(*(F.col(f"x.scores.{d}") for d in DIMS)).alias("alignment_vector"),
                       F.to_json(why).alias("rationales_json"), (F.col("x.rationales").isNull() & F.col("x.rationale").isNotNull()).alias("migrated")), errors


SPACES = " \t\r\n\f\x0b"


def _nonblank(c: Column) -> Column:
    return F.nullif(F.btrim(c, F.lit(SPACES)), F.lit(""))


def _first(lines: Column, test, after: Column | int = 0) -> Column:
    """The place, from 1, of the first line that passes and comes later than `after`; one more than there are lines if none does."""
    after = F.lit(after) if isinstance(after, int) else after
    places = F.filter(F.sequence(F.lit(1), F.size(lines) + 1), lambda k: (k > after) & ((k > F.size(lines)) | test(F.get(lines, k - 1))))
    return F.array_min(places)


def _text(lines: Column, begin: Column, end: Column) -> Column:
    """Lines begin to end - 1 as one text."""
    return F.array_join(F.slice(lines, begin, F.greatest(F.lit(0), end - begin)), "\n")


def _starts(*beginnings: str):
    return lambda line: reduce(lambda x, y: x | y, (F.startswith(line, F.lit(b)) for b in beginnings))


def _entry_lines(files: DataFrame) -> DataFrame:
    """persona_id, file, nth (from 1), head and lines of every section under a heading '## Entry ... date'."""
    lines = files.select(persona_of().alias("persona_id"), "file", F.posexplode(F.split("content", "\n")).alias("at", "line"))
    opens = F.startswith("line", F.lit("## Entry ")) & F.col("line").rlike(DATE)
    along = Window.partitionBy("persona_id", "file").orderBy("at")
    lines = lines.withColumn("nth", F.sum(opens.cast("int")).over(along)).where("nth > 0")
    whole = lines.groupBy("persona_id", "file", "nth").agg(F.array_sort(F.collect_list(F.struct("at", F.rtrim("line", F.lit("\r")).alias("line")))).alias("x"))
    return whole.select("persona_id", "file", "nth", F.col("x")[0]["line"].alias("head"), F.slice(F.col("x.line"), F.lit(2), F.size("x")).alias("lines"))


def wrangled_entries(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of '## Entry N - date' sections: (entries, warnings). Texts under 10 characters are a warning, not an entry.

    An entry is its text up to a line with the nudge's mark; the nudge stands in quotes on that line, and the response after
    its own mark up to a rule or a heading.
    """
    lines = F.col("lines")
    marked = lambda mark: lambda line: F.contains(line, F.lit(mark))
    sections = _entry_lines(files).where(F.split("head", " ")[2].try_cast("long").isNotNull())
    sections = sections.withColumns({"nudge_at": _first(lines, marked("**Nudge:**")), "answer_at": _first(lines, marked("**Response:**"))})
    has_nudge = F.col("nudge_at") <= F.size(lines)
    on = F.get(lines, F.col("nudge_at") - 1)
    before = F.concat_ws("\n", _text(lines, F.lit(1), F.col("nudge_at")), F.substring_index(on, "**Nudge:**", 1))
    plain = F.rtrim(F.btrim(_text(lines, F.lit(1), F.size(lines) + 1), F.lit(SPACES)), F.lit("-"))
    quoted = F.rtrim(F.substring_index(on, "**Nudge:**", -1))
    quoted = F.when(F.startswith(quoted, F.lit(' "')) & (F.locate('"', F.substring(quoted, 3, 1 << 30)) > 0), F.reverse(F.substring(quoted, 3, 1 << 30)))
    nudge = F.reverse(F.substr(quoted, F.locate('"', quoted) + 1))
    answer_end = _first(lines, _starts("---", "## "), F.col("answer_at"))
    answer = F.substring_index(_text(lines, F.col("answer_at"), answer_end), "**Response:** ", -1)
    rows = sections.select(
        "persona_id", "file", F.split("head", " ")[2].cast("long").alias("t_index"), F.regexp_extract("head", f"({DATE})", 1).alias("date"),
        _nonblank(F.when(has_nudge, before).otherwise(plain)).alias("initial_entry"), F.when(has_nudge, _nonblank(nudge)).alias("nudge_text"),
        F.when(has_nudge & (F.col("answer_at") <= F.size(lines)), _nonblank(answer)).alias("response_text"))
    rows = rows.withColumns({"has_nudge": F.col("nudge_text").isNotNull(), "has_response": F.col("response_text").isNotNull()})
    good = F.coalesce(F.length("initial_entry") >= 10, F.lit(False))
    return rows.where(good).drop("file"), rows.where(~good).select("file", "t_index", F.lit("entry is empty or too short").alias("message"))


def with_display_order(entries: DataFrame, registry: DataFrame) -> DataFrame:
    """Entries with their persona's annotation_order, which personas that the registry doesn't have lack."""
    return entries.join(registry.select("persona_id", "annotation_order"), "persona_id", "left")


def profile(files: DataFrame, fields=("Age", "Profession", "Culture", "Core Values", "Bio")) -> DataFrame:
    """Profile lines '- **Field:** value' (bold or not); a missing Bio is the first free paragraph."""
    lines = F.split(F.replace("content", F.lit("\r"), F.lit("")), "\n")
    bare = lambda line: F.ltrim(F.replace(line, F.lit("**"), F.lit("")), F.lit("-* \t"))
    df = files.select(persona_of().alias("persona_id"), lines.alias("lines"))
    lines = F.col("lines")

    def value(field: str) -> Column:
        at = _first(lines, lambda line: F.startswith(bare(line), F.lit(field + ":")))
        end = _first(lines, _starts("---", "## "), at) if field == "Bio" else at + 1
        return F.when(at <= F.size(lines), _nonblank(F.substr(bare(_text(lines, at, end)), F.lit(len(field) + 2))))

    title = F.get(lines, _first(lines, _starts("# ")) - 1)
    named = F.when(F.startswith(title, F.lit("# Persona ")) & F.contains(title, F.lit(": ")), F.substr(title, F.locate(": ", title) + 2)).otherwise(F.substr(title, F.lit(3)))
    free = F.get(lines, _first(lines, lambda line: (F.length(F.trim(line)) > 0) & ~_starts("#", "*", "-", " ", "\t")(line) & ~F.contains(F.substring_index(line, " ", 2), F.lit(":"))) - 1)
    cols = {f.lower().replace(" ", "_"): value(f) for f in fields}
    cols["bio"] = F.coalesce(cols.get("bio", F.lit(None).cast("string")), _nonblank(free))
    return df.select("persona_id", _nonblank(named).alias("name"), *(c.alias(k) for k, c in cols.items()))


#: Fixed values of the raw format: lines of metadata; marks, in any case, that there is no nudge, no response, or that a nudge
#: was not made; and whole responses that are none.
METADATA = "Tone:", "Verbosity:", "Reflection Mode:", "Mode:"
NO_NUDGE = r"\*\(No nudge[^\n]*\)\*"
NO_RESPONSE = r"\*\(No response[^\n]*\)\*"
NO_NUDGE_GENERATED = r"\[\s*No nudge generated[^\]]*\]"
PLACEHOLDERS = (
    r"\[N/?A\s*-\s*No nudge provided\]",
    r"\[No response recorded\]",
    r"\*\*\[No Response\]\*\*",
    r"\*No response recorded\*",
    r"\*\(No response[^\n]*\)\*",
)
DATE = r"\d{4}-\d{2}-\d{2}"


def raw_entries(files: DataFrame) -> DataFrame:
    """Entries of raw '## Entry' sections, numbered from 0 per file, with `problem` where a nudge section has no readable nudge.

    A section's lines are read by their headings. Three nudge formats are known by a line that begins with their mark: a
    quoted text after Trigger, a plain one after Category and a blank line, a block quote after Type.
    """
    lines = F.col("lines")
    inside = lambda line, mark: line.rlike(f"(?i){mark}")
    bare = lambda line: F.trim(F.replace(line, F.lit("**"), F.lit("")))
    marked = lambda name: F.exists(lines, lambda line: F.contains(line, F.lit(f"**{name}**:")) | F.contains(line, F.lit(f"**{name}:**")))
    df = _entry_lines(files)
    whole = F.array_join(lines, "\n")
    generated = inside(whole, NO_NUDGE_GENERATED)
    df = df.withColumns({
        "entry_at": _first(lines, _starts("### Initial Entry")), "nudge_at": _first(lines, _starts("### Nudge")), "answer_at": _first(lines, _starts("### Response")),
        "unanswered": F.exists(lines, lambda line: inside(line, NO_RESPONSE)), "wanted": F.exists(lines, _starts("### Nudge")) & ~F.exists(lines, lambda line: inside(line, NO_NUDGE)) & ~generated,
    })
    # The entry: leading blank lines and metadata go, and so does the mark that there is no nudge, wherever it stands.
    begins = _first(lines, lambda line: (F.length(F.trim(line)) > 0) & ~_starts(*METADATA)(bare(line)), F.col("entry_at"))
    ends = _first(lines, _starts("### Nudge", "---"), F.col("entry_at"))
    kept = F.filter(F.slice(lines, begins, F.greatest(F.lit(0), ends - begins)), lambda line: ~F.btrim(line, F.lit(SPACES)).rlike(f"(?i)^{NO_NUDGE}$"))
    # The nudge: what stands in its section after the line with the format's mark.
    until = _first(lines, lambda line: _starts("### Response", "---")(line) | inside(line, NO_RESPONSE), F.col("nudge_at"))
    mark = lambda name: _first(lines, _starts(f"**{name}**:", f"**{name}:**"), F.col("nudge_at"))
    after = lambda name: F.when(mark(name) < until, _text(lines, mark(name) + 1, until))
    quoted = F.btrim(after("Trigger"), F.lit(SPACES))
    quoted = F.when(F.startswith(quoted, F.lit('"')) & F.endswith(quoted, F.lit('"')) & (F.length(quoted) > 2), F.substring(quoted, F.lit(2), F.length(quoted) - 2))
    plain = F.when(F.trim(F.get(lines, mark("Category"))) == "", after("Category"))
    block = F.when(F.startswith(after("Type"), F.lit("> ")), F.substr(after("Type"), F.lit(3)))
    nudge = F.when(F.col("wanted"), _nonblank(F.when(marked("Trigger"), quoted).when(marked("Category"), plain).when(marked("Type"), block)))
    # The response: less a first line that tells its mode.
    mode = F.coalesce(_starts("Mode:", "Response Mode:")(bare(F.get(lines, F.col("answer_at")))), F.lit(False)).cast("int")
    answer = _nonblank(_text(lines, F.col("answer_at") + 1 + mode, _first(lines, _starts("---", "## "), F.col("answer_at"))))
    ticked = F.startswith(answer, F.lit("`")) & F.endswith(answer, F.lit("`")) & (F.length(answer) > 1)
    said = F.when(ticked, F.btrim(F.substring(answer, F.lit(2), F.length(answer) - 2), F.lit(SPACES))).otherwise(answer)
    nobody = F.coalesce(said.rlike(f"(?i)^(?:{'|'.join(PLACEHOLDERS)})$"), F.lit(False))
    out = df.select("persona_id", (F.row_number().over(Window.partitionBy("persona_id", "file").orderBy("nth")) - 1).cast("long").alias("t_index"), F.regexp_extract("head", f"({DATE})", 1).alias("date"),
                    _nonblank(F.array_join(kept, "\n")).alias("initial_entry"), nudge.alias("nudge_text"), F.when(~F.col("unanswered") & ~nobody, answer).alias("response_text"), "wanted")
    return out.select("persona_id", "t_index", "date", "initial_entry", "nudge_text", F.when(F.col("nudge_text").isNotNull(), F.col("response_text")).alias("response_text"),
                      F.when(F.col("wanted") & F.col("nudge_text").isNull(), "nudge section without a readable nudge").alias("problem"))


def union_runs(spark: SparkSession, runs: dict[str, str]) -> DataFrame:
    """Parquet tables of several runs, one below the other, with run_id; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.parquet(path).withColumn("run_id", F.lit(run)) for run, path in runs.items()))


def readable_runs(spark: SparkSession, runs: dict[str, str]) -> DataFrame:
    """`union_runs` of the tables that can be read and have a row; ValueError if none can."""
    from pyspark.errors import PySparkException

    good = {}
    for run, path in runs.items():
        try:
            if not spark.read.parquet(path).isEmpty():
                good[run] = path
        except PySparkException:
            continue
    if not good:
        raise ValueError("no table can be read")
    return union_runs(spark, good)


def resolve_paths(spark: SparkSession, paths: list[str], pattern: str = "persona_*.md") -> list[str]:
    """Files of the paths, in order and each once: a folder stands for its files of the pattern, by name. FileNotFoundError for
    a path that doesn't exist, a folder without such files, and no path at all."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out: dict[str, None] = {}
    for path in paths:
        at = hadoop(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(path)
        found = [at]
        if fs.getFileStatus(at).isDirectory():
            found = [x.getPath() for x in fs.globStatus(hadoop(at, pattern))]
            if not found:
                raise FileNotFoundError(f"{path}/{pattern}")
        out.update(dict.fromkeys(str(fs.resolvePath(x)) for x in found))
    if not out:
        raise FileNotFoundError("no path")
    return list(out)


def holdout_ids(spark: SparkSession, path: str, fields=("val_persona_ids", "test_persona_ids")) -> DataFrame:
    """persona_id and split of a manifest of YAML lists, one id a line under each field; ValueError if a field is missing or
    an id is in both."""
    ids: dict[str, list[str]] = {}
    field = None
    for row in spark.read.text(path, wholetext=True).first()["value"].split("\n"):
        line = row.split(" #")[0].rstrip()
        if line[:1] not in ("", " ", "-", "#") and ":" in line:
            field, rest = line.split(":", 1)
            ids[field] = [x.strip().strip("'\"") for x in rest.strip(" []").split(",") if x.strip()]
        elif line.lstrip().startswith("- ") and field:
            ids[field].append(line.lstrip()[2:].strip().strip("'\""))
    lacking = [f for f in fields if not ids.get(f)]
    both = set(ids.get(fields[0], ())) & set(ids.get(fields[1], ()))
    if lacking or both:
        raise ValueError(f"holdout manifest lacks {lacking}" if lacking else f"ids in both splits: {sorted(both)}")
    return spark.createDataFrame([(i, f.split("_")[0]) for f in fields for i in dict.fromkeys(ids[f])], "persona_id string, split string")


def load_frozen(spark: SparkSession, tables: dict[str, dict]) -> dict[str, DataFrame]:
    """Tables by name, each checked: `rows` and `fingerprint` as given, and `complete` (key, other table, its key): every key
    has a row there. ValueError names all that fail."""
    from pathwise.sources.sinks import fingerprint

    loaded = {name: spark.read.parquet(t["path"]) for name, t in tables.items()}
    wrong = []
    for name, t in tables.items():
        df = loaded[name]
        if "rows" in t and df.count() != t["rows"]:
            wrong.append(f"{name}: number of rows")
        if "fingerprint" in t and fingerprint(df) != t["fingerprint"]:
            wrong.append(f"{name}: fingerprint")
        if "complete" in t:
            key, other, its = t["complete"]
            if not df.join(loaded[other].select(F.col(its).alias(key)), key, "left_anti").isEmpty():
                wrong.append(f"{name}: {key} without a row of {other}")
    if wrong:
        raise ValueError("; ".join(wrong))
    return loaded


def packed(long: DataFrame, keys: list[str], values: list[str], size: int = len(DIMS)) -> DataFrame:
    """Rows of (keys, dim_index, values) as one row per key with aligned arrays; another number or order of dimensions raises."""
    assert_columns(long, [*keys, "dim_index", *values])
    out = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("dim_index", *values))).alias("_x"))
    whole = F.transform("_x", lambda x: x["dim_index"].cast("int")) == F.sequence(F.lit(0), F.lit(size - 1))
    checked = F.when(whole, F.col("_x")).otherwise(F.raise_error(F.lit(f"a key has other than dimensions 0 to {size - 1}")).cast(out.schema["_x"].dataType))
    return out.withColumn("_x", checked).select(*keys, *(F.col(f"_x.{v}").alias(v) for v in values))
