"""Readers of text reports: one row a file, parsed whole on the executors, long records out.

A report format is a function (text, context) -> records, registered in READERS; each file is one
task's value, as the formats keep state from line to line. Files are found and read by Spark, so
that any file system works. Every record carries its ordinal in the file, for rules that take the first.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.session import importable

SCHEMA = "source_file string, source string, ordinal long, object string, object_kind string, metric string, value double, unit string, workload string, operating_point string, tool string, tool_version string, run_id string, report_build string, report_date string, activity_mode string, error string"
Record = tuple[str, str, str, float | None, str]  # object, kind, metric, value, unit
_KEY = re.compile(r"^\s*([A-Za-z][\w ./-]{0,39}?)\s*[:=]\s*(.*)$")


class ReportError(ValueError):
    pass


def header(lines: list[str], first: str) -> tuple[dict[str, str], int]:
    """Key/value lines before the table whose first column is ``first``, and that table's line."""
    out: dict[str, str] = {}
    for i, line in enumerate(lines):
        words = line.split()
        if words and words[0].lower() == first.lower() and len(words) > 2:
            return out, i
        for part in re.split(r"\s{2,}(?=[A-Za-z][\w ./-]{0,39}\s*[:=])", line.strip().lstrip("#* ")):
            if found := _KEY.match(part):
                out[found[1].strip().lower()] = found[2].strip()
    raise ReportError(f"no table that begins with {first}")


def provenance(text: str) -> dict[str, str | None]:
    """What a report's first lines say of its tool, run, build, date and activity."""
    found: dict[str, str] = {}
    for line in text.splitlines()[:40]:
        for part in re.split(r"\s{2,}(?=[A-Za-z][\w ./-]{0,39}\s*[:=])", line.strip().lstrip("#* ")):
            if got := _KEY.match(part):
                found.setdefault(got[1].strip().lower(), got[2].strip())
    first = lambda *keys: next((found[k] for k in keys if found.get(k)), None)
    return {"tool": first("tool", "program"), "tool_version": first("version", "tool version"), "run_id": first("run", "run id", "run_id"), "report_build": first("build"), "report_date": first("date", "report date"), "activity_mode": (first("activity") or "").lower() or None}


def number(token: str) -> float | None:
    token = token.strip().rstrip("%")
    if token in ("", "-", "--") or token.lower() in ("n/a", "na"):
        return None
    try:
        return float(token.replace(",", ""))
    except ValueError:
        raise ReportError(f"not a number: {token}") from None


def unit_in(head: dict[str, str], what: str, default: str) -> str:
    for key, value in head.items():
        if what in key and "unit" in key:
            return value.split()[0].lower()
    return default


def rows_of(lines: list[str], at: int, least: int) -> Iterator[list[str]]:
    """Rows under a table's head: rules and blank lines are passed over."""
    for line in lines[at + 1 :]:
        words = line.split()
        if len(words) >= least and not set(line.strip()) <= set("-=+| "):
            yield words


def estimate(text: str, context: dict) -> Iterator[Record]:
    """Early power by hierarchy; its mode says which estimate."""
    lines = text.splitlines()
    head, at = header(lines, "hierarchy")
    mode = {"rtl": "logical", "logical": "logical", "physical": "physical", "physical-aware": "physical"}.get(head.get("mode", "").lower())
    if mode is None:
        raise ReportError(f"unknown mode {head.get('mode')}")
    unit = unit_in(head, "power", "mw")
    for w in rows_of(lines, at, 5):
        yield w[0], "fe_hier", f"fe_{mode}_mw", number(w[4]), unit
        if mode == "physical":
            yield w[0], "fe_hier", "fe_leakage_mw", number(w[3]), unit
            if len(w) > 5:
                yield w[0], "fe_hier", "cg_efficiency", number(w[5]), "1"


def signoff(text: str, context: dict) -> Iterator[Record]:
    """Signoff power as an indented tree: full paths are rebuilt below the top row, which is dropped."""
    lines = text.splitlines()
    head, at = header(lines, "hierarchy")
    unit, stack = unit_in(head, "power", "w"), []
    for line in lines[at + 1 :]:
        words = line.split()
        if len(words) < 5 or set(line.strip()) <= set("-=+| "):
            continue
        depth = len(line) - len(line.lstrip())
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, words[0]))
        if len(stack) > 1:
            path = "/".join(n for _, n in stack[1:])
            yield path, "be_hier", "be_mw", number(words[4]), unit
            yield path, "be_hier", "be_leakage_mw", number(words[3]), unit


def groups(text: str, context: dict) -> Iterator[Record]:
    """Signoff power by group, its columns found by name."""
    lines = text.splitlines()
    head, at = header(lines, "hierarchy")
    names = {"clock_network": "be_clock_mw", "register": "be_register_mw", "sequential": "be_register_mw", "combinational": "be_comb_mw", "memory": "be_memory_mw"}
    columns = [w.lower() for w in lines[at].split()]
    if "total" not in columns:
        raise ReportError("no column Total")
    unit = unit_in(head, "power", "mw")
    for w in rows_of(lines, at, len(columns)):
        for i, c in enumerate(columns):
            if c in names:
                yield w[0], "be_hier", names[c], number(w[i]), unit


def timing(text: str, context: dict) -> Iterator[Record]:
    lines = text.splitlines()
    head, at = header(lines, "partition")
    unit = unit_in(head, "time", "ps")
    for w in rows_of(lines, at, 6):
        for metric, i, u in (("clock_period_ps", 2, unit), ("wns_ps", 3, unit), ("tns_ps", 4, unit), ("violating_endpoints", 5, "1")):
            yield w[0], "partition", metric, number(w[i]), u


def parasitics(text: str, context: dict) -> Iterator[Record]:
    lines = text.splitlines()
    head, at = header(lines, "instance")
    unit = unit_in(head, "cap", "pf")
    for w in rows_of(lines, at, 5):
        yield w[0], "be_hier", "wire_cap_pf", number(w[3]), unit
        yield w[0], "be_hier", "cell_cap_pf", number(w[4]), unit


def implementation(text: str, context: dict) -> Iterator[Record]:
    lines = text.splitlines()
    head, at = header(lines, "hierarchy")
    unit = unit_in(head, "area", "um2")
    for w in rows_of(lines, at, 4):
        yield w[0], "be_hier", "area", number(w[1]), unit
        yield w[0], "be_hier", "cell_count", number(w[2]), "1"
        yield w[0], "be_hier", "fanout", number(w[3]), "1"
        if len(w) >= 7:
            yield w[0], "be_hier", "wire_length_um", number(w[5]), "um"
            yield w[0], "be_hier", "avg_net_length_um", number(w[6]), "um"


def second_engine(text: str, context: dict) -> Iterator[Record]:
    lines = text.splitlines()
    head, at = header(lines, "instance")
    unit = unit_in(head, "power", "mw")
    for w in rows_of(lines, at, 5):
        yield w[0], "be_hier", "be_voltus_mw", number(w[-1]), unit


def performance(text: str, context: dict) -> Iterator[Record]:
    for row in csv.DictReader(line for line in io.StringIO(text) if not line.startswith("#")):
        if row["metric"] in ("ipc", "throughput_gops"):
            yield context.get("design", "*"), "design", row["metric"], number(row["value"]), row.get("unit") or "1"


def profile(text: str, context: dict) -> Iterator[Record]:
    """Power windows; times in ns. The start of a window is its object."""
    head = "\n".join(line for line in text.splitlines() if line.startswith("#"))
    scale = {"ps": 1e-3, "ns": 1.0, "us": 1e3, "ms": 1e6}
    power = (re.search(r"power units?\s*[:=]\s*(\w+)", head, re.I) or ["", "mw"])[1].lower()
    for row in csv.DictReader(line for line in io.StringIO(text) if not line.startswith("#")):
        start = next((c for c in row if c.startswith("t_start")), None)
        end = next((c for c in row if c.startswith("t_end")), None)
        if start is None or end is None:
            raise ReportError("no columns t_start, t_end")
        unit = start.rpartition("_")[2]
        by = scale.get(unit if unit in scale else "ns")
        name = f"{(number(row[start]) or 0) * by:g}..{(number(row[end]) or 0) * by:g}"
        for part in ("total", "dynamic", "leakage"):
            if row.get(f"{part}_mw") is not None:
                yield name, "window", f"profile_{part}_mw", number(row[f"{part}_mw"]), power


def metadata(text: str, context: dict) -> Iterator[Record]:
    for op, x in json.loads(text).get("operating_points", {}).items():
        for metric, unit in (("frequency_ghz", "ghz"), ("voltage_v", "v")):
            if x.get(metric) is not None:
                yield op, "design", metric, float(x[metric]), unit


class Activity:
    """Reads switching activity line by line: toggles of an instance's own and inner nets, per net and simulated cycle.

    A stack of open parentheses is all that is held, so a file may be as long and as deep as it likes. An instance's
    records come when it closes; a file that breaks off has given some by then, and its error row says so.
    """

    def __init__(self, context: dict):
        self.period, self.kind = context.get("sim_clock_period_ps"), context.get("object_kind", "be_hier")
        self.stack: list[list] = []  # [first word, further words, toggles, nets] of each open parenthesis
        self.path: list[str] = []
        self.cycles: float | None = None
        self.head: dict[str, list[str]] = {}
        self.seen = False

    def lines(self, lines: Iterable[str]) -> Iterator[Record]:
        for line in lines:
            if line.count('"') % 2:
                raise ReportError("a string that does not end on its line")
            for token in re.findall(r'"[^"]*"|[()]|[^\s()"]+', line.partition("//")[0]):
                if token == "(":
                    self.stack.append([None, [], 0.0, 0])
                elif token == ")":
                    if not self.stack:
                        raise ReportError("unbalanced parentheses")
                    yield from self._close(*self.stack.pop())
                elif self.stack:
                    self._word(self.stack[-1], token.strip('"'))

    def end(self) -> None:
        if self.stack:
            raise ReportError("unbalanced parentheses")
        if not self.seen:
            raise ReportError("not a SAIF file")
        self._duration()

    def _word(self, top: list, word: str) -> None:
        if top[0] is None:
            top[0] = word
            self.seen |= word == "SAIFILE" and len(self.stack) == 1
        elif len(top[1]) < 2:  # no list that counts has more
            top[1].append(word)
            if top[0] == "INSTANCE" and len(top[1]) == 1:
                self.path.append(word)

    def _duration(self) -> None:
        unit = {"fs": 1e-3, "ps": 1.0, "ns": 1e3, "us": 1e6}
        scale = self.head.get("TIMESCALE", ["1", "ns"])
        duration = float(self.head.get("DURATION", ["0"])[0]) * float(scale[0]) * unit[scale[1]]
        if duration <= 0 or not self.period:
            raise ReportError("no duration before the first instance, or an unknown period")
        self.cycles = duration / float(self.period)

    def _close(self, word: str | None, words: list[str], toggles: float, nets: int) -> Iterator[Record]:
        above = [x[0] for x in self.stack[-2:]]
        if above == ["SAIFILE"]:
            self.head[word] = words
        if word == "INSTANCE":
            if self.cycles is None:
                self._duration()
            if len(self.path) > 1 and nets:
                name = "/".join(self.path[1:])
                yield name, self.kind, "activity", toggles / nets / self.cycles, "1"
                yield name, self.kind, "bits_per_cycle", toggles / self.cycles, "1"
                yield name, self.kind, "net_count", float(nets), "1"
            self.path.pop()
        elif len(above) == 2 and above[0] == "NET":  # a count of a net: the last TC is the net's
            value = float(words[0]) if words else 0.0
            if word == "TC":
                self.stack[-1][2] = value
            return
        elif above[-1:] == ["NET"]:
            nets = 1
        elif word != "NET":
            return
        if self.stack:
            self.stack[-1][2] += toggles
            self.stack[-1][3] += nets


def activity(text: str, context: dict) -> Iterator[Record]:
    """Switching activity of a text at hand."""
    reader = Activity(context)
    yield from reader.lines(text.split("\n"))
    reader.end()


#: Sources that are read line by line; their files can be larger than a task's memory.
STREAMED = {"activity": Activity}


#: source -> (reader, where its files lie under a run)
READERS: dict[str, tuple[Callable[[str, dict], Iterator[Record]], str]] = {
    "estimate": (estimate, "pprtl/*/*_power.rpt"),
    "signoff": (signoff, "primepower/*/power_hier.rpt"),
    "groups": (groups, "primepower/*/power_groups.rpt"),
    "profile": (profile, "primepower/*/power_profile.csv"),
    "timing": (timing, "primetime/*/timing_summary.rpt"),
    "parasitics": (parasitics, "starrc/parasitics_summary.rpt"),
    "implementation": (implementation, "implementation/qor_summary.rpt"),
    "activity": (activity, "activity/*.saif"),
    "performance": (performance, "perf/*.csv"),
    "second_engine": (second_engine, "voltus/*/power_hier.rpt"),
    "metadata": (metadata, "metadata.json"),
}
_CORNER = {"timing": "op", "activity": "wl"}


def context_of(path: str, source: str) -> dict:
    """Workload and operating point that a file's path names."""
    name = path.rstrip("/").split("/")[-1 if source in ("activity", "performance") else -2].rsplit(".", 1)[0] if source != "metadata" else ""
    if source in ("parasitics", "implementation", "metadata"):
        return {}
    if _CORNER.get(source) == "op":
        return {"operating_point": name}
    if _CORNER.get(source) == "wl":
        return {"workload": name}
    workload, _, op = name.rpartition("_")
    return {"workload": workload or name, "operating_point": op if workload else None}


def _context_under(path: str, known: dict[str, dict]) -> dict:
    """What is known of the folder that holds a file."""
    folder = path
    while "/" in folder:
        folder = folder.rpartition("/")[0]
        if folder in known:
            return known[folder]
    return {}


def _read_lines(spark: SparkSession, files: str, source: str, known: dict[str, dict], context: dict) -> DataFrame:
    """Long records of files read as streams of lines: a file is one task's, in order, but never held whole."""
    lines = spark.read.text(files).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    names, nothing, make = [c.split()[0] for c in SCHEMA.split(", ")], [None] * 6, STREAMED[source]

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        path, reader, own, n, failed = None, None, {}, 0, False

        def rows(found: Iterable[Record], end: bool = False) -> list[tuple]:
            nonlocal n, failed
            out = []
            try:
                for r in found:
                    out.append((path, source, n, *r, own.get("workload"), own.get("operating_point"), *nothing, None))
                    n += 1
                if end:
                    reader.end()
            except (ValueError, KeyError, IndexError, TypeError, AttributeError) as e:
                failed = True
                out.append((path, source, n, *[None] * 7, *nothing, f"{type(e).__name__}: {e}"))
            return out

        for batch in batches:
            out = []
            for new, group in batch.groupby("path", sort=False):
                if new != path:
                    if reader is not None and not failed:
                        out += rows((), end=True)
                    path, own, n, failed = new, _context_under(new, known) | context | context_of(new, source), 0, False
                    reader = make(own)
                if not failed:
                    out += rows(reader.lines(group["value"]))
            yield pd.DataFrame(out, columns=names)
        if reader is not None and not failed:
            yield pd.DataFrame(rows((), end=True), columns=names)

    return lines.repartition("path").sortWithinPartitions("path", "block", "at").mapInPandas(parse, SCHEMA)


def read_reports(spark: SparkSession, run: str, source: str, pattern: str | None = None, contexts: dict[str, dict] | None = None, **context) -> DataFrame:
    """Long records of one source under a run's folder, or under many by a glob; a file that cannot be parsed is a row with its error
    (a source that is read as a stream may have given records before; ``ingest.accepted`` drops these).

    contexts: what is known of each run, by its folder (a row of metadata a run); a file's run is the folder among them that holds it.
    """
    importable(spark)
    reader, own_pattern = READERS[source]
    if source in STREAMED:
        return _read_lines(spark, f"{run.rstrip('/')}/{pattern or own_pattern}", source, contexts or {}, context)
    files = spark.read.text(f"{run.rstrip('/')}/{pattern or own_pattern}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    known = contexts or {}

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for text, path in zip(batch["value"], batch["path"], strict=True):
                own = _context_under(path, known) | context | context_of(path, source)
                rows, error = [], None
                try:
                    rows = list(reader(text, own))
                except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError) as e:
                    rows, error = [], f"{type(e).__name__}: {e}"
                said = provenance(text) if source not in ("metadata", "performance", "activity") else dict.fromkeys(("tool", "tool_version", "run_id", "report_build", "report_date", "activity_mode"))
                said = list(said.values())
                op = own.get("operating_point")
                out = [(path, source, i, *r, own.get("workload"), r[0] if source == "metadata" else op, *said, None) for i, r in enumerate(rows)] if error is None else [(path, source, 0, None, None, None, None, None, None, None, *said, error)]
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.mapInPandas(parse, SCHEMA)


def parse_states(text: str) -> list[tuple[str, str | None, str | None, str | None, float | None]]:
    """(domain, element, supply net, state, voltage) of a power-intent file: each domain's elements by the states of its supply.

    States without a number (off) are left out; a domain without elements or states still has a row.
    """
    text = re.sub(r"\\\s*\n", " ", re.sub(r"#[^\n]*", "", text))
    elements: dict[str, list[str]] = {}
    supply: dict[str, str] = {}
    states: dict[str, dict[str, float]] = {}
    for line in text.splitlines():
        if found := re.match(r"\s*create_power_domain\s+(\S+)(.*)", line):
            listed = re.search(r"-elements\s+\{([^}]*)\}", found[2])
            elements.setdefault(found[1], []).extend(listed[1].split() if listed else [])
        elif found := re.match(r"\s*set_domain_supply_net\s+(\S+).*-primary_power_net\s+(\S+)", line):
            supply[found[1]] = found[2]
            elements.setdefault(found[1], [])
        elif found := re.match(r"\s*add_port_state\s+(\S+)\s+(.*)", line):
            numbers = re.findall(r"\{\s*(\S+)\s+(\d+(?:\.\d+)?)\s*\}", found[2])
            states.setdefault(found[1], {}).update({k: float(v) for k, v in numbers})
    out = []
    for domain, own in elements.items():
        net = supply.get(domain)
        at = states.get(net, {}) or {None: None}
        out += [(domain, e, net, state, volts) for e in own or [None] for state, volts in at.items()]
    return out


def parse_upf(text: str) -> list[tuple[str, str, float | None]]:
    """(domain, element, highest numeric supply voltage) of a power-intent file."""
    most: dict[tuple[str, str], float | None] = {}
    for domain, element, _, _, volts in parse_states(text):
        if element is not None:
            now = most.get((domain, element))
            most[domain, element] = volts if now is None else max(now, volts)
    return [(d, e, v) for (d, e), v in most.items()]


INTENT = "path string, domain string, element string, supply_net string, state string, voltage double, error string"


def read_intent(spark: SparkSession, root: str, pattern: str = "intent/*.upf") -> DataFrame:
    """Power domains of each run's first intent file (by name) under a folder or glob."""
    importable(spark)
    files = spark.read.text(f"{root.rstrip('/')}/{pattern}", wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    first = files.groupBy(folder.alias("folder")).agg(F.min("path").alias("path")).select("path")

    def parse(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            out = []
            for text, path in zip(batch["value"], batch["path"], strict=True):
                out += [(path, *row, None) for row in parse_states(text)] or [(path, None, None, None, None, None, "no power domain")]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in INTENT.split(", ")])

    return files.join(first, "path", "left_semi").mapInPandas(parse, INTENT)


#: Fixed: the stage that a source reports on, the version that its reader was written for, and whether a run may lack it.
SPECS = {k: ({"estimate": "FE", "activity": "ACTIVITY", "performance": "PERF", "metadata": "DESIGN"}.get(k, "BE"), "1", k in ("groups", "profile", "performance", "second_engine")) for k in READERS}


def source_table(spark: SparkSession, disabled: list[str] = (), patterns: dict[str, str] | None = None) -> DataFrame:
    """The registry: each source's stage, pattern, version, and whether it is on."""
    rows = [(k, SPECS[k][0], (patterns or {}).get(k, p), SPECS[k][1], SPECS[k][2], "disabled" if k in disabled else "enabled") for k, (_, p) in READERS.items()]
    return spark.createDataFrame(rows, "source string, stage string, pattern string, versions string, optional boolean, state string")
