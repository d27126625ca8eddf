"""Sections and names of single-file components, taken with regular expressions.

The patterns take what a simple reader takes: the first ``<template>`` or ``<script>`` without
attributes up to the first closing tag, the first ``<style ...>``, and lists up to the first closing
bracket. Nested templates, ``<script setup>`` and shorthand entries are therefore cut or missed; that
is the format's meaning here. No match is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stem, strip

# Fixed values.
TEMPLATE = r"(?s)<template>(.*?)</template>"
SCRIPT = r"(?s)<script>(.*?)</script>"
STYLE = r"(?s)<style.*?>(.*?)</style>"
NAME = r"name:\s*['\"]([^'\"]+)['\"]"
PROPS_OBJECT = r"(?s)props:\s*\{([^}]+)\}"
PROPS_ARRAY = r"(?s)props:\s*\[(.*?)\]"
COMPONENTS = r"(?s)components:\s*\{([^}]+)\}"
KEY = r"(?U)(\w+)\s*:"
QUOTED = r"['\"]([^'\"]+)['\"]"


def _none() -> Column:
    return F.array().cast("array<string>")


def section(content: Column, pattern: str) -> Column:
    return F.when(F.rlike(content, F.lit(pattern)), strip(F.regexp_extract(content, pattern, 1)))


def template(content: Column) -> Column:
    return section(content, TEMPLATE)


def script(content: Column) -> Column:
    return section(content, SCRIPT)


def style(content: Column) -> Column:
    return section(content, STYLE)


def component_name(script_: Column, path: Column) -> Column:
    """The first quoted name of the script, else the file's stem."""
    return F.coalesce(F.when(F.length(F.regexp_extract(script_, NAME, 1)) > 0, F.regexp_extract(script_, NAME, 1)), stem(path))


def props(script_: Column) -> Column:
    """Keys of the object form; if there is none, what is quoted in the array form; else empty."""
    keys = F.regexp_extract_all(F.regexp_extract(script_, PROPS_OBJECT, 1), F.lit(KEY), F.lit(1))
    quoted = F.regexp_extract_all(F.regexp_extract(script_, PROPS_ARRAY, 1), F.lit(QUOTED), F.lit(1))
    return F.when(F.rlike(script_, F.lit(PROPS_OBJECT)), keys).when(F.rlike(script_, F.lit(PROPS_ARRAY)), quoted).otherwise(_none())


def components(script_: Column) -> Column:
    keys = F.regexp_extract_all(F.regexp_extract(script_, COMPONENTS, 1), F.lit(KEY), F.lit(1))
    return F.when(F.rlike(script_, F.lit(COMPONENTS)), keys).otherwise(_none())
