"""Texts for people: normalised documents and settings."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, functions as F


def bracketed(items: Column) -> Column:
    """[a, b, c]"""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def sentences_text(tokens: Column) -> Column:
    """An array of token arrays as lines: each sentence, indented, then all tokens."""
    lines = F.transform(tokens, lambda x: F.concat(F.lit("\t"), bracketed(x)))
    return F.array_join(F.concat(F.array(F.lit("Normalized Sentences")), lines, F.array(F.lit("Tokens"), F.concat(F.lit("\t"), bracketed(F.flatten(tokens))))), "\n")


def settings_text(options) -> str:
    """The fields of an options object in four lines: numbers, what is switched on, what is switched off, and the rest."""
    values = {f.name: getattr(options, f.name) for f in dataclasses.fields(options)}
    switches = [n for n, v in values.items() if isinstance(v, bool)]
    numbers = {n: v for n, v in values.items() if n not in switches and isinstance(v, (int, float))}
    rest = {n: v for n, v in values.items() if n not in switches and n not in numbers}
    listed = lambda pairs: ", ".join(f"{n} = {v}" for n, v in pairs.items())
    lines = {"Numbers": listed(numbers), "On": ", ".join(n for n in switches if values[n]), "Off": ", ".join(n for n in switches if not values[n]), "Others": listed(rest)}
    return "\n".join(f"{name}: {text}".rstrip() for name, text in lines.items())
