"""Lexical and vector retrieval, rank fusion, and evidence selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentions, question_tokens

CHANNEL_LIMIT = 20
RRF_K = 60
WEIGHTS = {"keyword": 1.0, "vector": 1.0, "graph": 0.5}


def keyword_scores(docs: DataFrame, question: str, text: str = "text") -> DataFrame:
    """RET-06 and AGG-05: ``docs`` whose text holds at least one of the question's tokens, with how many as ``score``. One pass; the question is a constant of the plan."""
    lower = F.lower(F.col(text))
    score = F.lit(0)
    for token in question_tokens(question):
        score = score + lower.contains(token).cast("int")
    return docs.withColumn("score", score).where("score > 0")


def top(scored: DataFrame, k: int, *order: str, score: str = "score") -> DataFrame:
    """SRT-01 and SRT-02: the k best by score, ties by ``order``: each partition keeps k rows, and those are merged."""
    return scored.orderBy(F.desc(score), *order).limit(k)


def cosine(vector: Column | str, query: list[float]) -> Column:
    """RET-17: the cosine with a given vector, between -1 and 1; null for a vector of another width, of norm 0 or with a component that isn't finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    v = F.transform(vector, lambda x: x.cast("double"))
    q = F.array(*(F.lit(float(x)) for x in query))
    sum_ = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    norm = F.sqrt(sum_(F.transform(v, lambda x: x * x))) * F.lit(sum(x * x for x in map(float, query)) ** 0.5)
    value = sum_(F.zip_with(v, q, lambda a, b: a * b)) / norm
    ok = (F.size(v) == len(query)) & (norm > 0) & valid_vector(vector)
    return F.when(ok, F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)))


def valid_vector(vector: Column | str) -> Column:
    """SRC-20: whether all components are there and finite."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def ranked(scored: DataFrame, channel: str, key: str, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """WIN-01: a channel's best rows by (-score, key), ranked from 1: key, channel, score, rank. At most ``limit`` rows meet in one task."""
    best = scored.select(F.col(key).alias("key"), F.col("score").cast("double").alias("score")).orderBy(F.desc("score"), "key").limit(limit)
    rank = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "key"))
    return best.withColumn("channel", F.lit(channel)).withColumn("rank", rank)


def fused(channels: DataFrame, k: int = RRF_K, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """RET-09, AGG-04: reciprocal rank fusion of ranked channels: key, fused (rounded to 9 places), n_channels."""
    weight = F.coalesce(*(F.when(F.col("channel") == c, F.lit(w)) for c, w in weights.items()), F.lit(0.0))
    return channels.groupBy("key").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("fused"), F.count(F.lit(1)).alias("n_channels"))


def diverse(rows: DataFrame, path: str = "path") -> DataFrame:
    """WIN-03 and WIN-04: pinned rows and the first of each file come first (a file with a pinned row is served by it), the others follow in order: adds ``position``. ``rows`` (key, fused, pinned, path) is a fused list, bounded by the channels' limits."""
    order = [F.desc("pinned"), F.desc("fused"), "key"]
    per_file = Window.partitionBy(path)
    first = (F.row_number().over(per_file.orderBy(*order)) == 1) & ~F.max("pinned").over(per_file)
    front = F.col("pinned") | first
    return rows.withColumn("front", front).withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("front"), *order))).drop("front")


def exact_mentions(docs: DataFrame, values: list[str], text: str = "text") -> DataFrame:
    """RET-05: one row for each document and value that it names. The values are constants of the plan."""
    named = F.array_compact(F.array(*(F.when(mentions(text, v), F.lit(v)) for v in values)))
    return docs.withColumn("value", F.explode(named))


def intent(question: Column | str) -> Column:
    """RET-02: the first that applies of entry, impact and dependency, else general."""
    text = F.lower(question)
    # The words that tell an intent.
    words = lambda *w: F.lit(False) if not w else text.rlike("|".join(w))
    entry = words("入口", "启动") | text.rlike(r"\b(entry|main)\b")
    return F.when(entry, "entry").when(words("影响", "impact", "改动", "修改"), "impact").when(words("依赖", "import", "调用", "call"), "dependency").otherwise("general")


def route(question: Column | str) -> tuple[Column, Column, Column]:
    """RET-19: strategy, intent and target of a question, by the first rule that applies."""
    text = F.col(question) if isinstance(question, str) else question
    lower = F.lower(text)
    # The rules' words, in order.
    cross = lower.rlike(r"跨模块|跨文件|调用链|cross[- ](?:module|file)|call (?:chain|graph)")
    steps = lower.rlike(r"排查|诊断|多步|逐步|debug|investigat|multi[- ]step|step.by.step")
    file = F.regexp_extract(text, r"(?:^|[^\w/\\.:-])([\w.-]+(?:/[\w.-]+)*\.py)(?:$|[^\w/\\.])", 1)
    symbol = F.regexp_extract(text, r"`([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)`", 1)
    target = F.coalesce(F.nullif(file, F.lit("")), F.nullif(symbol, F.lit("")))
    found = F.when(lower.rlike("影响|修改|变更|impact|change|modif"), "impact").when(lower.rlike("依赖|dependenc|imports?"), "dependency").when(target.endswith(".py"), "explain").otherwise("general")
    entry, tour = lower.rlike(r"入口|entry\b|entrypoint"), lower.rlike("入门|阅读顺序|概览|onboard|overview")
    agent = cross | steps
    strategy = F.when(agent, "agent").when(target.isNotNull() | entry | tour, "fast").otherwise("agent")
    purpose = F.when(agent, "general").when(target.isNotNull(), found).when(entry, "entry").when(tour, "onboard").otherwise("general")
    return strategy, purpose, F.when(~agent, target)


def reasons_of(channels: DataFrame) -> DataFrame:
    """RET-09 and SET-01: key, fused, n_channels and reason (each channel's rank, in the channels' order) of ranked channels; a channel counts once for a key, at its best score."""
    best = channels.groupBy("key", "channel").agg(F.min("rank").alias("rank"))
    place = F.coalesce(*(F.when(F.col("channel") == c, F.lit(i)) for i, c in enumerate(WEIGHTS)), F.lit(len(WEIGHTS)))
    each = F.struct(place.alias("place"), F.concat("channel", F.lit("_rank="), F.col("rank").cast("string")).alias("text"))
    told = best.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["text"]), ";").alias("reason"))
    return fused(best).join(told, "key")


def role(path: Column, channels: Column) -> Column:
    """RET-10: test files are tests, what only the graph found is a dependency, all else a definition."""
    test = path.startswith("tests/") | F.element_at(F.split(path, "/"), -1).startswith("test_")
    return F.when(test, "test").when(channels == "graph", "dependency").otherwise("definition")


def best_file(questions: DataFrame, key: list[str], text: str, paths: list[str]) -> DataFrame:
    """RET-03: the one path that a question names in full, else the one whose last part it names; none if several are. ``paths`` is a list of stated candidates."""
    named = lambda values: F.array_compact(F.array(*(F.when(mentions(text, v), F.lit(p)) for p, v in values)))
    whole, base = named([(p, p) for p in paths]), named([(p, p.rsplit("/", 1)[-1]) for p in paths])
    one = lambda found: F.when(F.size(found) == 1, F.get(found, F.lit(0)))
    return questions.select(*key, F.coalesce(one(whole), one(base)).alias("target"))


def sufficiency(rules: dict[str, Column]) -> Column:
    """RET-20: why evidence does not suffice, in the order of the rules; nothing if it does."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items()))), ",")


def pack_evidence(candidates: DataFrame, budget: int, limit: int = 6, per_file: int = 2) -> DataFrame:
    """RET-14: for each query, the items kept in order of ``position`` under a budget of bytes, and why others go: query, position, path, reason, cost (of the kept ones).

    ``candidates``: query, position, path, start_line, end_line, exact (found by name), cost (its rendered bytes). Reasons: token_budget, overlap, item_limit,
    file_diversity. A choice is one fold over a query's candidates (60 at most, by its channels' limits); as long as what it keeps costs too much, the largest
    kept item, exact ones last, is put aside and the fold is made again. No group function: both are expressions on an array.
    """
    fields = ["position", "path", "start_line", "end_line", "exact", "cost"]
    rows = candidates.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    kind = "array<struct<item:struct<position:int,path:string,start_line:int,end_line:int,exact:boolean,cost:bigint>,reason:string>>"

    def choose(aside: Column) -> Column:
        def judge(done: Column, item: Column) -> Column:
            kept = F.filter(done, lambda d: d["reason"] == "kept")
            same = F.filter(kept, lambda d: d["item"]["path"] == item["path"])
            equal = F.exists(same, lambda d: (d["item"]["start_line"] == item["start_line"]) & (d["item"]["end_line"] == item["end_line"]))
            meets = F.exists(same, lambda d: (d["item"]["start_line"] <= item["end_line"]) & (d["item"]["end_line"] >= item["start_line"]))
            why = F.when(F.array_contains(aside, item["position"]), "token_budget").when(equal, "overlap").when(F.size(kept) >= limit, "item_limit")
            why = why.when(~item["exact"] & meets, "overlap").when(~item["exact"] & (F.size(same) >= per_file), "file_diversity").otherwise("kept")
            return F.concat(done, F.array(F.struct(item.alias("item"), why.alias("reason"))))

        return F.aggregate("items", F.array().cast(kind), judge)

    total = lambda done: F.aggregate(done, F.lit(0).cast("bigint"), lambda s, d: s + F.when(d["reason"] == "kept", d["item"]["cost"]).otherwise(0))

    def evict(aside: Column, _: Column) -> Column:
        done = choose(aside)
        kept = F.filter(done, lambda d: d["reason"] == "kept")
        largest = F.array_max(F.transform(kept, lambda d: F.struct((~d["item"]["exact"]).alias("loose"), d["item"]["cost"].alias("cost"), d["item"]["position"].alias("position"))))
        return F.when(total(done) > budget, F.concat(aside, F.array(largest["position"]))).otherwise(aside)

    aside = F.aggregate("items", F.array().cast("array<int>"), evict)
    chosen = rows.withColumn("aside", aside).select("query", choose(F.col("aside")).alias("done"))
    return chosen.select("query", F.explode("done").alias("d"), total(F.col("done")).alias("cost")).select("query", "d.item.position", "d.item.path", "d.reason", "cost")


#: Decisions on discarded items that a pack's summary shows, and bytes kept free for the labels around it.
MOST_DISCARDED, LABELS = 20, 512
#: Why an item is discarded.
DISCARDED = ("item_limit", "overlap", "file_diversity", "token_budget")


def rendered_costs(items: DataFrame, text: str = "text") -> DataFrame:
    """RET-15: ``items`` (path, start_line, end_line, exact, text) with what each takes as bytes of UTF-8: ``tool``, as JSON beside its line of evidence, and ``prompt``, as a headed block."""
    line = F.format_string("%s:%d-%d", "path", "start_line", "end_line")
    shown = F.to_json(F.struct("path", "start_line", "end_line", "exact", F.col(text).alias("text")))
    block = F.concat(F.lit("["), line, F.lit("]\n"), F.col(text), F.lit("\n"))
    return items.withColumns({"tool": (F.octet_length(shown) + F.octet_length(line) + 2).cast("long"), "prompt": F.octet_length(block).cast("long")})


def pack_rendered(candidates: DataFrame, budget: int, limit: int = 6, per_file: int = 2) -> DataFrame:
    """RET-14 and RET-15: ``pack_evidence`` under the bytes that the whole pack takes as it is rendered: query, position, path, reason, cost, shown.

    ``candidates`` have tool and prompt (see ``rendered_costs``) in place of cost. A pack costs 512 bytes and the larger of its two shapes: all items as a JSON list with their lines, or all blocks with a
    summary of the decisions. The summary shows as many of the first 20 discarded items as fit; where the pack doesn't fit even without them, its largest item, exact ones last, is put aside and the choice is made again.
    A query whose pack can't be made to fit has no item that is kept.
    """
    fields = ["position", "path", "start_line", "end_line", "exact", "tool", "prompt"]
    rows = candidates.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("items"))
    kind = "array<struct<item:struct<position:int,path:string,start_line:int,end_line:int,exact:boolean,tool:bigint,prompt:bigint>,reason:string>>"
    kept_of = lambda done: F.filter(done, lambda d: d["reason"] == "kept")

    def choose(aside: Column) -> Column:
        def judge(done: Column, item: Column) -> Column:
            same = F.filter(kept_of(done), lambda d: d["item"]["path"] == item["path"])
            equal = F.exists(same, lambda d: (d["item"]["start_line"] == item["start_line"]) & (d["item"]["end_line"] == item["end_line"]))
            meets = F.exists(same, lambda d: (d["item"]["start_line"] <= item["end_line"]) & (d["item"]["end_line"] >= item["start_line"]))
            why = F.when(F.array_contains(aside, item["position"]), "token_budget").when(equal, "overlap").when(F.size(kept_of(done)) >= limit, "item_limit")
            why = why.when(~item["exact"] & meets, "overlap").when(~item["exact"] & (F.size(same) >= per_file), "file_diversity").otherwise("kept")
            return F.concat(done, F.array(F.struct(item.alias("item"), why.alias("reason"))))

        return F.aggregate("items", F.array().cast(kind), judge)

    def measure(done: Column, shown: Column) -> Column:
        total = lambda name: F.aggregate(kept_of(done), F.lit(0).cast("bigint"), lambda s, d: s + d["item"][name])
        gone = F.filter(done, lambda d: d["reason"] != "kept")
        listed = F.transform(F.slice(gone, F.lit(1), shown), lambda d: F.struct(d["item"]["path"].alias("path"), d["item"]["start_line"].alias("start_line"), d["item"]["end_line"].alias("end_line"), d["reason"].alias("reason")))
        count = lambda reason: F.size(F.filter(gone, lambda d: d["reason"] == reason)).alias(reason)
        summary = F.to_json(F.struct(F.lit(budget).alias("budget"), F.size(kept_of(done)).alias("selected"), F.size(gone).alias("discarded_count"), listed.alias("discarded"), F.struct(*map(count, DISCARDED)).alias("reasons")))
        return LABELS + F.greatest(total("tool") + F.size(kept_of(done)) + 1, total("prompt") + F.octet_length(summary))

    none = F.lit(0)

    def evict(aside: Column, _: Column) -> Column:
        done = choose(aside)
        largest = F.array_max(F.transform(kept_of(done), lambda d: F.struct((~d["item"]["exact"]).alias("loose"), d["item"]["tool"].alias("tool"), d["item"]["position"].alias("position"))))
        return F.when((measure(done, none) > budget) & (F.size(kept_of(done)) > 0), F.concat(aside, F.array(largest["position"]))).otherwise(aside)

    aside = F.aggregate("items", F.array().cast("array<int>"), evict)
    chosen = rows.withColumn("aside", aside).select("query", choose(F.col("aside")).alias("done"))
    fitting = F.filter(F.sequence(F.lit(0), F.lit(MOST_DISCARDED)), lambda k: (k <= F.size(F.filter("done", lambda d: d["reason"] != "kept"))) & (measure(F.col("done"), k) <= budget))
    chosen = chosen.withColumn("shown", F.coalesce(F.array_max(fitting), F.lit(0)))
    chosen = chosen.withColumn("cost", measure(F.col("done"), F.col("shown")))
    return chosen.select("query", F.explode("done").alias("d"), "cost", "shown").select("query", "d.item.position", "d.item.path", "d.reason", "cost", "shown")


def fit_context(messages: DataFrame, budget: int) -> DataFrame:
    """RET-22 and RET-24: of each conversation (conv_id, turn, role, text), the messages that stay under ``budget`` bytes: conv_id, turn, role, cost, used, status.

    System messages are protected: they always stay. Then come the others from the last turn back, as long as they fit; of equal texts the latest alone counts. Where the protected
    ones alone exceed the budget, they are all that is left and the conversation's status is ``refused``. A window over the conversation, no group function.
    """
    cost = F.octet_length("text").cast("long") + 16
    latest = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy(F.desc("turn")))
    guarded = F.coalesce(F.col("role") == "system", F.lit(False))
    order = Window.partitionBy("conv_id").orderBy(F.desc("guarded"), F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    unique = messages.withColumn("copy", latest).where("copy = 1").withColumns({"cost": cost, "guarded": guarded})
    unique = unique.withColumns({"used": F.sum("cost").over(order), "least": F.sum(F.when(F.col("guarded"), F.col("cost"))).over(Window.partitionBy("conv_id"))})
    refused = F.coalesce(F.col("least") > budget, F.lit(False))
    kept = unique.withColumn("status", F.when(refused, "refused").otherwise("ok")).where(F.col("guarded") | (F.col("used") <= budget))
    return kept.select("conv_id", "turn", "role", "cost", "used", "status")


def hash_embedding(texts: DataFrame, key: str, text: str = "text", width: int = 64) -> DataFrame:
    """RET-18: a deterministic stand-in for an embedding: key, slot, value, the slots that aren't 0. Slot 0 is always 1; each token adds or takes 1 at a slot that its SHA-256 names."""
    tokens = texts.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z_0-9]*|[\u4e00-\u9fff]"), F.lit(0))).alias("token"))
    counted = tokens.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("hex", F.sha2("token", 256))
    byte = lambda i: F.conv(F.substring("hex", 2 * i + 1, 2), 16, 10).cast("long")
    slot = 1 + (byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216) % (width - 1)
    sign = F.when(byte(4) % 2 == 1, F.col("n")).otherwise(-F.col("n"))
    rows = counted.groupBy(key, slot.cast("int").alias("slot")).agg(F.sum(sign).alias("value")).where("value <> 0")
    return rows.unionByName(texts.select(key, F.lit(0).alias("slot"), F.lit(1).cast("long").alias("value")))


def fit_planner(messages: DataFrame, budget: int, answer: int = 0) -> DataFrame:
    """RET-23: of each conversation, what stays of a planner's input under ``budget`` bytes, of which ``answer`` are kept free for what the planner writes: user messages go first, the oldest first, then answers, the latest first. System messages are protected; where they alone don't fit, every row is ``refused``."""
    cost = F.octet_length("text").cast("long")
    worth = F.when(F.col("role") == "system", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    order = Window.partitionBy("conv_id").orderBy("worth", F.when(F.col("worth") == 2, -F.col("turn")).otherwise(F.col("turn"))).rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumns({"cost": cost, "worth": worth}).withColumn("used", F.sum("cost").over(order))
    guarded = F.coalesce(F.sum(F.when(F.col("worth") == 0, F.col("cost"))).over(Window.partitionBy("conv_id")), F.lit(0))
    room = budget - answer
    return rows.select("conv_id", "turn", "role", F.when(guarded > room, "refused").when(F.col("used") <= room, "kept").otherwise("context_budget").alias("decision"))
