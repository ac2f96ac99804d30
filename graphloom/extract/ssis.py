"""Facts of data-flow packages in XML. Names of elements and attributes count without their namespace."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.windows import matched

_SCHEMA = "file_name string, kind string, task string, task_no int, name string, ref string, direction string, value string, pos int"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attributes(e: ET.Element) -> dict[str, str]:
    return {_local(k): v for k, v in e.attrib.items()}


def _children(e: ET.Element, name: str) -> Iterator[ET.Element]:
    return (c for c in e if _local(c.tag) == name)


def _facts(text: str) -> Iterator[tuple]:
    """(kind, task, task_no, name, ref, direction, value) of a package, in document order."""
    try:
        root = ET.fromstring(text)
    except ET.ParseError as error:
        yield "error", None, None, None, None, None, str(error)
        return
    own = _attributes(root)
    yield "package", None, None, own.get("ObjectName"), own.get("DTSID"), None, own.get("CreatorName")
    for e in root.iter():
        tag, a = _local(e.tag), _attributes(e)
        if tag == "ConnectionManager" and a.get("ObjectName"):
            text_of = next((v for x in e.iter() for k, v in _attributes(x).items() if k == "ConnectionString"), None)
            yield "connection", None, None, a["ObjectName"], a.get("CreationName"), None, text_of
        elif tag == "Variable" and a.get("ObjectName"):
            value = next((x.text for x in e.iter() if _local(x.tag) == "VariableValue"), None)
            yield "variable", None, None, a["ObjectName"], a.get("Namespace"), None, value
        elif tag == "PrecedenceConstraint":
            yield "precedence", None, None, a.get("ObjectName"), a.get("From"), a.get("To"), a.get("Value")
    tasks = [t for holder in _children(root, "Executables") for t in _children(holder, "Executable")]
    for n, task in enumerate(tasks):
        a = _attributes(task)
        name = a.get("ObjectName")
        yield "task", name, n, name, a.get("CreationName") or a.get("ExecutableType"), None, None
        for e in task.iter():
            b = _attributes(e)
            if _local(e.tag) == "component":
                yield "component", name, n, b.get("name"), b.get("componentClassID"), None, None
                for way in ("inputs", "outputs"):
                    for holder in _children(e, way):
                        for end in _children(holder, way[:-1]):
                            yield "end", name, n, b.get("name"), _attributes(end).get("name"), way[:-1], None
                for p in e.iter():
                    if _local(p.tag) == "property":
                        yield "property", name, n, b.get("name"), _attributes(p).get("name"), None, p.text
            elif "SqlStatementSource" in b:
                yield "sql", name, n, name, "SqlStatementSource", None, b["SqlStatementSource"]
            elif "PackageName" in b or _local(e.tag) == "PackageName":
                yield "package_link", name, n, name, None, None, b.get("PackageName") or e.text


def facts(files: DataFrame) -> DataFrame:
    """All facts of packages (file_name, text), one row each; a file that is no XML gives one row of kind error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(f, kind, task, no, name, ref, way, value, pos) for f, text in zip(part["file_name"], part["text"], strict=True) for pos, (kind, task, no, name, ref, way, value) in enumerate(_facts(text or ""))]
            out = pd.DataFrame(rows, columns=["file_name", "kind", "task", "task_no", "name", "ref", "direction", "value", "pos"])
            out["task_no"] = out["task_no"].astype("Int32")
            yield out

    return files.select("file_name", "text").mapInPandas(run, _SCHEMA)


def tasks(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'task'").select("file_name", "task_no", "name", F.col("ref").alias("task_type"))


def components(found: DataFrame) -> DataFrame:
    """Components with their properties as a map, the last of a name."""
    last = found.filter("kind = 'property' AND ref IS NOT NULL").groupBy("file_name", "task_no", "name", "ref").agg(F.max_by("value", "pos").alias("value"))
    items = last.groupBy("file_name", "task_no", "name").agg(F.map_from_entries(F.collect_list(F.struct("ref", "value"))).alias("properties"))
    rows = found.filter("kind = 'component'").select("file_name", "task", "task_no", "name", F.col("ref").alias("component_class"))
    return matched(rows, items, ["file_name", "task_no", "name"], "left")


def flows(found: DataFrame) -> DataFrame:
    """Data flow between components of a task: an output and an input of one name, of different components."""
    ends = found.filter("kind = 'end'").select("file_name", "task", "task_no", "name", "ref", "direction").distinct()
    out = ends.filter("direction = 'output'").select("file_name", "task", "task_no", "ref", F.col("name").alias("source"))
    into = ends.filter("direction = 'input'").select("file_name", "task_no", "ref", F.col("name").alias("target"))
    return matched(out, into, ["file_name", "task_no", "ref"]).filter("source <> target").select("file_name", "task", "source", "target", F.col("ref").alias("path"))


def sql_statements(found: DataFrame) -> DataFrame:
    """SQL of components (properties named after sql or command) and of tasks (an attribute)."""
    named = F.lower("ref").contains("sql") | F.lower("ref").contains("command")
    return found.filter((F.col("kind") == "sql") | ((F.col("kind") == "property") & named)).filter("value IS NOT NULL").select("file_name", "task", "name", F.col("ref").alias("property_name"), F.col("value").alias("sql"))


def precedence(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'precedence'").select("file_name", F.col("ref").alias("from_task"), F.col("direction").alias("to_task"), "value")


def _levels(rules: pd.DataFrame) -> pd.DataFrame:
    """Steps of the tasks of one file, by taking off those that wait for none, level by level."""
    after: dict[str, list[str]] = {}
    waits: dict[str, int] = {}
    for a, b in set(zip(rules["from_task"], rules["to_task"], strict=True)):
        after.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
        waits.setdefault(a, 0)
    step: dict[str, int | None] = dict.fromkeys(waits)
    now, level = [t for t, n in waits.items() if n == 0], 0
    while now:
        following = []
        for t in now:
            step[t] = level
            for b in after.get(t, ()):
                waits[b] -= 1
                if waits[b] == 0:
                    following.append(b)
        now, level = following, level + 1
    file_name = rules["file_name"].iloc[0]
    return pd.DataFrame({"file_name": file_name, "task": list(step), "step": pd.array(list(step.values()), "Int32")})


def execution_order(found: DataFrame) -> DataFrame:
    """Tasks with their step: one more than the latest of those before. Tasks on a cycle, or behind one, have none (null).

    The rules of a file stand in one text, so a task that has read that can hold them: one shuffle, and work in proportion to the rules.
    """
    return precedence(found).filter("from_task IS NOT NULL AND to_task IS NOT NULL").select("file_name", "from_task", "to_task").groupBy("file_name").applyInPandas(_levels, "file_name string, task string, step int")
