"""Parsers by id: each turns files of one source type into facts; users add their own. Packages can be read in SQL, too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.extract import sql, ssis
from graphloom.operators import package

#: Entities, transformations and relations of files (file_name, text), as the knowledge packages take them.
Facts = tuple[DataFrame, DataFrame, DataFrame]


class ParserNotFoundError(LookupError):
    """No parser has that id."""


@dataclass(frozen=True)
class Parser:
    parser_id: str
    source_type: str
    facts: Callable[[DataFrame], Facts]


class Parsers:
    def __init__(self) -> None:
        self._by_id: dict[str, Parser] = {}

    def register(self, parser_id: str, source_type: str, facts: Callable[[DataFrame], Facts]) -> None:
        """The last parser registered under an id is the one in use."""
        self._by_id[parser_id] = Parser(parser_id, source_type, facts)

    def get(self, parser_id: str) -> Parser:
        if parser_id not in self._by_id:
            raise ParserNotFoundError(f"no parser {parser_id!r}; there are: {', '.join(self.available())}")
        return self._by_id[parser_id]

    def available(self) -> list[str]:
        return sorted(self._by_id)

    def facts(self, files: DataFrame) -> DataFrame:
        """What all parsers find in files (file_name, source_type, text), each fact once: (file_name, parser_id, kind, type, name, target).

        Each parser gets the files of its source type alone; two parsers of one type both read them. Files of other types have no facts
        (see ``unparsed``). Only relations have a target.
        """
        return reduce(DataFrame.unionByName, [_listed(p, p.facts(files.filter(F.col("source_type") == p.source_type))) for p in map(self.get, self.available())]).distinct()

    def unparsed(self, files: DataFrame) -> DataFrame:
        """Files that no parser reads, those without a source type among them."""
        return files.filter(~F.coalesce(F.col("source_type").isin(*{p.source_type for p in self._by_id.values()}), F.lit(False)))


def _listed(parser: Parser, found: Facts) -> DataFrame:
    row = lambda rows, kind, of, name, target=None: rows.select("file_name", F.lit(parser.parser_id).alias("parser_id"), F.lit(kind).alias("kind"), F.col(of).alias("type"), F.col(name).alias("name"), (F.col(target) if target else F.lit(None).cast("string")).alias("target"))
    entities, rules, relations = found
    return row(entities, "ENTITY", "entity_type", "name").unionByName(row(rules, "TRANSFORMATION", "rule_type", "rule_id")).unionByName(row(relations, "RELATION", "type", "source", "target"))


def built_in() -> Parsers:
    """Scripts, programs and packages."""
    parsers = Parsers()
    parsers.register("cobol", "cobol", package.program_facts)
    parsers.register("sql", "sql", lambda files: package.script_facts(sql.prepared(files)))
    parsers.register("ssis", "ssis", package.package_facts)
    return parsers


class PackageFacts:
    """The facts of one package's text, in document order; of null or empty text and of no XML one of kind error."""

    def eval(self, text: str) -> Iterator[tuple]:
        for pos, (kind, task, task_no, name, ref, direction, value) in enumerate(ssis._facts(text or "")):
            yield kind, task, task_no, name, ref, direction, value, pos


def register_sql(spark: SparkSession, name: str = "package_facts") -> None:
    """A table function of a package's text for SQL: ``FROM files f, LATERAL package_facts(f.text) p``."""
    spark.udtf.register(name, F.udtf(PackageFacts, returnType="kind string, task string, task_no int, name string, ref string, direction string, value string, pos int"))
