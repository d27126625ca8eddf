"""Files to fragments, the text that fragments are embedded by, and counts of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.project import EXTENSIONS

TAGGED = (("template", "<template>\n", "\n</template>"), ("script", "<script>\n", "\n</script>"), ("style", "<style scoped>\n", "\n</style>"))


def _fragment(kind: str | Column, name: Column, content: Column, **meta: Column) -> Column:
    null = F.lit(None).cast("string")
    none = F.lit(None).cast("array<string>")
    get = lambda k, d: meta.get(k, d).alias(k)
    info = F.struct(F.col("path").alias("file_path"), F.col("file_name"), get("component_name", null), get("props", none), get("components", none), get("extension", null), get("file_type", null))
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(kind.alias("type"), name.alias("name"), content.alias("content"), info.alias("metadata"))


def _made() -> tuple[Column, Column]:
    """The fragments of a parsed file as an array, and whether it has any: files with errors or ignored have none."""
    ext, name, raw = F.lower("extension"), F.coalesce("component_name", F.regexp_replace("file_name", r"\.vue", "")), F.col("raw_content")
    lists = {"props": F.coalesce("props", F.array().cast("array<string>")), "components": F.coalesce("components", F.array().cast("array<string>"))}
    parts = [_fragment("component", name, raw, component_name=name, **lists)]
    for section, before, after in TAGGED:
        text = F.col(section)
        whole = _fragment(section, F.concat(name, F.lit(f"_{section}")), F.concat(F.lit(before), text, F.lit(after)), component_name=name, **(lists if section == "script" else {}))
        parts.append(F.when(F.length(text) > 0, whole))
    kind = F.when(ext.isin(".js", ".ts"), F.lit("javascript")).when(ext == ".css", F.lit("css")).when(ext == ".html", F.lit("html")).otherwise(F.lit("generic"))
    other = _fragment(kind, F.col("file_name"), raw, extension=F.col("extension"), file_type=F.when(kind == "html", F.lit("html")))
    made = F.when(ext == ".vue", F.filter(F.array(*parts), lambda x: x.isNotNull())).otherwise(F.array(other))
    return made, F.col("error").isNull() & ~F.coalesce("ignored", F.lit(False)) & raw.isNotNull()


def fragments(parsed: DataFrame) -> DataFrame:
    """``id, type, name, content, metadata`` of each parsed file; files with errors or ignored have none.

    A component's file gives the whole file and, in this order, its template, script and style where
    they aren't empty; other files give one fragment by their extension. An id is a digest of path,
    type and content, so the same fragment has the same id in every run.
    """
    made, good = _made()
    out = parsed.where(good).select("path", F.posexplode(made).alias("part", "f"))
    return out.select(F.sha2(F.concat_ws("\x1f", "path", "f.type", "f.content"), 256).alias("id"), "f.type", "f.name", "f.content", "f.metadata", "part")


def fragments_per_file(parsed: DataFrame) -> DataFrame:
    """``path, n_fragments`` of each file: 0 for those without any."""
    made, good = _made()
    return parsed.select("path", F.when(good, F.size(made)).otherwise(F.lit(0)).cast("long").alias("n_fragments"))


def type_counts(frags: DataFrame) -> DataFrame:
    return frags.groupBy("type").agg(F.count("*").alias("n"))


def fragment_stats(frags: DataFrame) -> DataFrame:
    """One row: all fragments, how many of each type, and components with props and with components of their own.

    Nothing has a ``by_component_type``, which is an empty map. Counts by file, as many as there are
    files, are in ``fragment_stats_table``.
    """
    component = F.col("type") == "component"
    types = frags.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if(component & (F.size("metadata.props") > 0)).alias("props"), F.count_if(component & (F.size("metadata.components") > 0)).alias("components")
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return types.agg(
        total("n").alias("total_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("by_type"), F.create_map().cast("map<string,long>").alias("by_component_type"),
        total("props").alias("has_props"), total("components").alias("has_components"),
    )


def fragment_stats_table(frags: DataFrame) -> DataFrame:
    """``stat, key, n``: ``total_count``, ``has_props`` and ``has_components`` (components with any; no key), ``by_type`` and ``by_file``.

    It is a table as there are as many files as there may be. Nothing has a ``by_component_type``, so
    there are no rows of it. The fragments are read once: counts by type and file are taken first.
    """
    component = F.col("type") == "component"
    each = frags.groupBy("type", F.col("metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.count_if(component & (F.size("metadata.props") > 0)).alias("props"), F.count_if(component & (F.size("metadata.components") > 0)).alias("components")
    )
    sums = each.groupingSets([[], [F.col("type")], [F.col("file")]], "type", "file").agg(F.grouping_id().alias("of"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "props", "components")))
    row = lambda stat, key, n: F.struct(F.lit(stat).alias("stat"), key.cast("string").alias("key"), F.col(n).alias("n"))
    none = F.lit(None)
    whole = F.array(row("total_count", none, "n"), row("has_props", none, "props"), row("has_components", none, "components"))
    told = F.when(F.col("of") == 3, whole).when(F.col("of") == 1, F.array(row("by_type", F.col("type"), "n"))).otherwise(F.array(row("by_file", F.col("file"), "n")))
    return sums.select(F.explode(told).alias("x")).select("x.*")


def file_counts() -> list[Column]:
    """Aggregates of files: all of them, those read without error, and how many have each of the scanned extensions."""
    own = [F.count_if(F.col("extension") == e).alias(f"ext_{e}") for e in EXTENSIONS]
    return [F.count("*").alias("total_files"), F.count_if(F.col("error").isNull() & ~F.coalesce("ignored", F.lit(False))).alias("components_count"), *own]


def summary(counts: dict[str, int]) -> dict:
    """A parse summary of the values of ``file_counts``."""
    return {"total_files": counts["total_files"], "components_count": counts["components_count"], "by_extension": {k[4:]: n for k, n in counts.items() if k.startswith("ext_") and n}}


def parse_summary(files: DataFrame) -> DataFrame:
    """A row for each extension, files and files read without error, and one of all (a null extension)."""
    counts = files.groupBy("extension").agg(F.count("*").alias("total_files"), F.count_if(F.col("error").isNull()).alias("parsed_ok_count"))
    return counts.rollup("extension").agg(F.sum("total_files").alias("total_files"), F.sum("parsed_ok_count").alias("parsed_ok_count"))


def embedding_text(type_: Column, name: Column, content: Column, component_name: Column, props: Column, components: Column, file_name: Column) -> Column:
    """What a fragment is embedded by: labels joined by bars, a blank line, and its content."""
    own = F.coalesce(component_name, name)
    # The labels of each type and of the file.
    label = (
        F.when(type_ == "component", F.concat(F.lit("Vue 컴포넌트: "), name))
        .when(type_ == "template", F.concat(F.lit("Vue 템플릿: "), own))
        .when(type_.isin("script", "javascript"), F.concat(F.lit("Vue 스크립트: "), own))
        .when(type_ == "style", F.concat(F.lit("Vue 스타일: "), own))
        .when(type_ == "css", F.concat(F.lit("CSS 파일: "), name))
        .when(type_ == "html", F.concat(F.lit("HTML 파일: "), name))
    )
    listed = lambda label, x: F.when((type_ == "component") & (F.size(x) > 0), F.concat(F.lit(label), F.array_join(x, ", ")))
    context = F.concat_ws(" | ", label, listed("Props: ", props), listed("Components: ", components), F.concat(F.lit("파일: "), file_name))
    return F.concat(context, F.lit("\n\n"), content)
