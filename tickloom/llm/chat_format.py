"""Chat formatting of records in many layouts.

The paths of a record's nested fields are hashed to a fingerprint; the
fingerprint selects a declarative mapping that says where the turns are. The
canonical turns are written in one template that marks turns and escapes control
strings inside texts, so that both can be read back.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

START, END = "<|turn|>", "<|end|>"
#: First characters of control strings, and what follows them.
_REST = r"(?:/?s>|/?INST\]|/?SYS>>|\||/?im_\w+>)"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_REST})")
_UNESCAPE = re.compile(rf"([<\[])(\\*)\\(?={_REST})")


def escape(text: str) -> str:
    """A backslash, one more than there were, after the first character of each control string."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Mapping:
    """turns: (list path, role field, text field), or (field, role) pairs in order; roles: other names of roles."""

    name: str
    fields: frozenset[str]
    each: tuple[str, str, str] | None = None
    singles: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()


ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping("turns", frozenset({"turns[].role", "turns[].text"}), ("turns", "role", "text")),
    Mapping("messages", frozenset({"messages[].role", "messages[].content"}), ("messages", "role", "content")),
    Mapping("conversations", frozenset({"conversations[].from", "conversations[].value"}), ("conversations", "from", "value")),
    Mapping("instruction", frozenset({"instruction", "output"}), None, (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), frozenset({"input", "system"})),
    Mapping("prompt_response", frozenset({"prompt", "response"}), None, (("system", "system"), ("prompt", "user"), ("response", "assistant")), frozenset({"system"})),
    Mapping("prompt_completion", frozenset({"prompt", "completion"}), None, (("system", "system"), ("prompt", "user"), ("completion", "assistant")), frozenset({"system"})),
    Mapping("question_answer", frozenset({"question", "answer"}), None, (("context", "user"), ("question", "user"), ("answer", "assistant")), frozenset({"context"})),
)


def paths(value: object) -> set[str]:
    """Paths of the leaves of a record; `[]` stands for any element of a list or an empty list, `[]=` for elements that are no objects."""
    out, todo = set(), [(value, "")]
    while todo:
        own, at = todo.pop()
        if isinstance(own, dict):
            todo += [(v, f"{at}.{k}" if at else k) for k, v in own.items()]
        elif isinstance(own, list):
            out.update([f"{at}[]"] if not own else [])
            for v in own:
                if isinstance(v, (dict, list)):
                    todo.append((v, f"{at}[]"))
                else:
                    out.add(f"{at}[]=")
        else:
            out.add(at)
    return out


def fingerprint(found: set[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


class Layouts:
    """The mapping of a record by the fingerprint of those of its paths that any mapping names; other fields don't matter."""

    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS) -> None:
        self.mappings = mappings
        lists = {x for m in mappings if m.each for x in (f"{m.each[0]}[]", f"{m.each[0]}[]=")}
        self.named = frozenset().union(lists, *(m.fields | m.optional for m in mappings))
        self.chosen: dict[str, Mapping | None] = {}

    def _fits(self, m: Mapping, found: set[str]) -> bool:
        if not m.each:
            return m.fields <= found
        return f"{m.each[0]}[]=" not in found and (m.fields <= found or f"{m.each[0]}[]" in found)

    def __call__(self, record: dict) -> tuple[str, Mapping | None]:
        """(fingerprint, the first mapping that fits or None)."""
        found = paths(record) & self.named
        mark = fingerprint(found)
        if mark not in self.chosen:
            self.chosen[mark] = next((m for m in self.mappings if self._fits(m, found)), None)
        return mark, self.chosen[mark]


def turns_of(record: dict, mapping: Mapping) -> list[tuple[str, str]]:
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if mapping.each:
        rows, role, own = mapping.each
        found = [(text(t.get(role)), text(t.get(own))) for t in record.get(rows) or [] if isinstance(t, dict)]
        return [(ROLES.get(r, r) if mapping.name == "conversations" else r, t) for r, t in found]
    return [(role, text(record[f])) for f, role in mapping.singles if f in record and (f not in mapping.optional or record[f])]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans (code points) of it that the loss mask covers: assistants' texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_back(formatted: str) -> list[tuple[str, str]]:
    out = []
    for part in formatted.split(START)[1:]:
        role, _, text = part.removesuffix(END).partition("\n")
        out.append((_role_in(role), unescape(text)))
    return out


def format_records(records: DataFrame, column: str = "record") -> DataFrame:
    """records with `layout`, `fingerprint`, `formatted` and `loss_mask` (array of start, end) of a JSON column.

    Only the paths that some mapping names make the fingerprint, so that fields
    beside them don't matter; of several mappings that fit, the first counts.
    Records that no mapping fits, that are null, no JSON object or nested too
    deeply have layout and formatted null; an empty list of turns formats as the
    empty text. Repeated rows are the same each, an empty table gives none.
    Columns of these names are replaced; rows and other columns stay.
    """

    @F.pandas_udf("layout string, fingerprint string, formatted string, loss_mask array<struct<start:long,end:long>>")
    def formatted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        layouts = Layouts()

        def one(raw: str | None) -> tuple:
            mark = None
            try:
                record = json.loads(raw) if isinstance(raw, str) else None
                if isinstance(record, dict):
                    mark, m = layouts(record)
                    if m:
                        text, mask = render(turns_of(record, m))
                        return m.name, mark, text, [{"start": a, "end": b} for a, b in mask]
            except (ValueError, RecursionError):
                pass
            return None, mark, None, None

        for column_ in batches:
            yield pd.DataFrame(map(one, column_), columns=["layout", "fingerprint", "formatted", "loss_mask"])

    out = records.withColumn("__f", formatted(column))
    for c in ("layout", "fingerprint", "formatted", "loss_mask"):
        out = out.withColumn(c, F.col(f"__f.{c}"))
    return out.drop("__f")


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows (conv_id, turn, role, text) as one JSON record each, by turn, then role and text, in the layout that fits its turns.

    A question and an answer, after a system text or not, are a prompt and a
    response; of others, those with an even id are messages, the rest turns.

    Null roles and texts are empty, null turns come first; repeated rows stay each;
    null conv_ids are one conversation; an empty table gives none. A conversation
    goes to one task whole, as its record does.
    """
    turn = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    pairs = lambda role, text: F.transform("turns", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))
    text = lambda i: F.try_element_at("turns", F.lit(i))["text"]
    roles = F.transform("turns", lambda t: t["role"])
    are = lambda *names: roles == F.array(*map(F.lit, names))
    record = (
        F.when(are("user", "assistant"), F.to_json(F.struct(text(1).alias("prompt"), text(2).alias("response"))))
        .when(are("system", "user", "assistant") & (text(1) != ""), F.to_json(F.struct(text(1).alias("system"), text(2).alias("prompt"), text(3).alias("response"))))
        .when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(pairs("role", "content").alias("messages"))))
        .otherwise(F.to_json(F.struct(pairs("role", "text").alias("turns"))))
    )
    return grouped.select("conv_id", record.alias("record"))


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(texts: pd.Series, masks: pd.Series) -> pd.DataFrame:
    out = []
    for text, mask in zip(texts, masks, strict=True):
        turns = read_back(text)
        loss = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
        all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
        out.append((len(turns), _sha(all_), len(loss), _sha(loss), len(text)))
    return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_records(records_of(rows)).withColumn("d", F.pandas_udf(_digest, _DIGEST)("formatted", "loss_mask"))
    return out.select("conv_id", "d.*", "layout", "fingerprint")


SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\||/?im_\w+>)', '\1\2\\\3', 'g') as escaped from t),
g as (select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(escaped) + length(role) + 16) as bigint) as formatted_chars,
       string_agg(role, ',' order by turn, role, text) as roles, min_by(text, turn) as first_text from e group by conv_id),
f as (select *, case when roles = 'user,assistant' then 'prompt' when roles = 'system,user,assistant' and first_text <> '' then 'system' when conv_id % 2 = 0 then 'messages' else 'turns' end as kind from g)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, case when kind in ('prompt', 'system') then 'prompt_response' else kind end as layout,
       substr(sha256(case kind when 'prompt' then 'prompt' || chr(10) || 'response' when 'system' then 'prompt' || chr(10) || 'response' || chr(10) || 'system'
         when 'messages' then 'messages[].content' || chr(10) || 'messages[].role' else 'turns[].role' || chr(10) || 'turns[].text' end), 1, 16) as fingerprint
from f
"""
