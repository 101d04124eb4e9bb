"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block; blocks are
concatenated. A block is START role LF text (TURN text)* END LF. Control strings inside texts and roles are escaped
reversibly, so parse() gives the turns back.

Nulls and ties: null text is empty and a null role is an empty role; a null conv_id is a conversation of its own; rows
with equal turn are ordered by role, then text; repeated rows stay. Null turns come first. Extra columns are ignored.
The work for a conversation is linear in its text, but for running sums within GROUP turns and over its groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, TURN, END = "<|im_start|>", "<|turn|>", "<|im_end|>"
MARK = "␛"
GROUP = 64
#: What is escaped, and the code after MARK. MARK itself comes first; it is undone last.
ESCAPES = ((MARK, "0"), ("<|", "1"), ("|>", "2"), ("<s>", "3"), ("</s>", "4"), ("[INST]", "5"), ("[/INST]", "6"), ("<<SYS>>", "7"), ("<</SYS>>", "8"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(MARK + code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(MARK + code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(MARK + "9"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(MARK + "9"), F.lit("\n")))


def format_chat(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """A row per conversation: conv_id, formatted, and loss_runs, the run lengths (code points) of the loss mask."""
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.when(i > 1, i - 1).otherwise(i))["role"]),
    )

    def block(at: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.size("turns") + 1)
        texts = F.transform(F.slice("turns", at, after - at), lambda t: escape(t["text"]))
        return F.struct(F.element_at("turns", at)["role"].alias("role"), texts.alias("texts"))

    def shown(b: Column) -> Column:
        return F.concat(F.lit(START), escape_role(b["role"]), F.lit("\n"), F.array_join(b["texts"], TURN), F.lit(END + "\n"))

    def mask(b: Column) -> Column:
        run = lambda n, loss: F.struct(n.cast("int").alias("chars"), F.lit(loss).alias("loss"))
        head = F.length(escape_role(b["role"])) + len(START) + 1
        inside = F.flatten(F.transform(b["texts"], lambda t, i: F.array(run(F.when(i > 0, len(TURN)).otherwise(0), False), run(F.length(t), True))))
        none = F.array(run(F.length(shown(b)), False))
        return F.when(b["role"] == loss_role, F.concat(F.array(run(head, False)), inside, F.array(run(F.lit(len(END) + 1), False)))).otherwise(none)

    return (
        sorted_turns.withColumn("starts", starts)
        .select("conv_id", F.transform("starts", block).alias("blocks"))
        .select("conv_id", F.array_join(F.transform("blocks", shown), "").alias("formatted"), F.flatten(F.transform("blocks", mask)).alias("loss_runs"))
    )


def _quoted(control: str) -> str:
    return control.replace("|", "\\|")


def parse(formatted: Column) -> Column:
    """The turns, array<struct<role, text>>, of a formatted conversation."""
    blocks = F.filter(F.split(formatted, _quoted(END) + "\n", -1), lambda b: b != "")

    def turns(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = unescape_role(F.substring(b, F.lit(len(START) + 1), cut - len(START) - 1))
        texts = F.split(F.substring(b, cut + 1, F.length(b)), _quoted(TURN), -1)
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def _starts(lengths: Column) -> Column:
    """Running sums of an array before each of its elements."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda have, n: F.struct((have["at"] + n).alias("at"), F.concat(have["starts"], F.array(have["at"])).alias("starts"))
    return F.aggregate(lengths, none, step, lambda have: have["starts"])


def with_loss_text(formatted: DataFrame, name: str = "loss_text") -> DataFrame:
    """format_chat()'s rows with the text under their loss mask, each run cut out of formatted by its place and unescaped.

    Runs go in groups of GROUP: the text is cut into groups first, then each group into its runs, so that running sums and
    cuts stay short however many turns there are.
    """
    last = F.greatest(F.ceil(F.size("loss_runs") / GROUP).cast("int") - 1, F.lit(0))
    cut = formatted.withColumn("_runs", F.transform(F.sequence(F.lit(0), last), lambda k: F.slice("loss_runs", k * GROUP + 1, GROUP)))
    cut = cut.withColumn("_sizes", F.transform("_runs", lambda g: F.aggregate(g, F.lit(0), lambda n, r: n + r["chars"])))
    cut = cut.withColumn("_groups", F.arrays_zip("_runs", "_sizes", _starts(F.col("_sizes")).alias("_at")))
    cut = cut.withColumn("_groups", F.transform("_groups", lambda g: F.struct(g["_runs"].alias("runs"), F.substring(F.col("formatted"), g["_at"] + 1, g["_sizes"]).alias("part"))))

    def under(g: Column) -> Column:
        placed = F.arrays_zip(g["runs"].alias("run"), _starts(F.transform(g["runs"], lambda r: r["chars"])).alias("at"))
        wanted = F.filter(placed, lambda x: x["run"]["loss"])
        return F.array_join(F.transform(wanted, lambda x: unescape(F.substring(g["part"], x["at"] + 1, x["run"]["chars"]))), "")

    return cut.withColumn(name, F.array_join(F.transform("_groups", under), "")).drop("_runs", "_sizes", "_groups")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; digests are of what parse() and the loss mask read from the output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    read = with_loss_text(format_chat(rows.unionByName(extra)).withColumn("turns", parse(F.col("formatted"))), "loss")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _sql_escaped(text: str) -> str:
    for plain, code in ESCAPES:
        text = f"replace({text}, '{plain}', '{MARK}{code}')"
    return text


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS opens FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escaped("text")}) + CASE WHEN opens THEN {len(START) + 1 + len(END) + 1} + length(replace({_sql_escaped("role")}, chr(10), '{MARK}9')) ELSE {len(TURN)} END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
