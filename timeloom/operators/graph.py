"""Graphs of nodes and links as edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timeloom.plans.materialise import checkpointed


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): what each node reaches, with the least number of steps.

    Semi-naive: each round extends only what the round before found first, until a round finds nothing. That ends cycles.
    """
    reached = checkpointed(edges.select("src", "dst", F.lit(1).alias("depth")).distinct())
    new, depth = reached, 1
    while True:
        depth += 1
        step = new.select("src", F.col("dst").alias("mid")).join(edges.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        new = checkpointed(step.join(reached.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
        if new.isEmpty():
            return reached
        # a plan of few parts however long the chains are
        reached = reached.unionByName(new) if depth % 8 else checkpointed(reached.unionByName(new).coalesce(reached.rdd.getNumPartitions()))


def sockets(edges: DataFrame) -> DataFrame:
    """The targets of each node, in order."""
    return edges.groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("targets"), F.count("*").alias("n"))


def socket_links(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The links (id, src, src_slot, dst, dst_slot) at each socket of the nodes (id): (node, way, slot, links); an input has its
    last link alone, an output all of its own in order. Links to nodes that don't exist are left out."""
    out = links.groupBy(F.col("src").alias("node"), F.col("src_slot").alias("slot")).agg(F.array_sort(F.collect_list("id")).alias("links")).withColumn("way", F.lit("out"))
    into = links.groupBy(F.col("dst").alias("node"), F.col("dst_slot").alias("slot")).agg(F.array(F.max("id")).alias("links")).withColumn("way", F.lit("in"))
    return out.unionByName(into).join(nodes.select(F.col("id").alias("node")).distinct(), "node", "left_semi").select("node", "way", "slot", "links")


def origins(nodes: DataFrame, edges: DataFrame, passing: str = "Reroute") -> DataFrame:
    """For every link its true origin: links out of pass-through nodes are followed back, through however many there are.

    Where pass-through nodes feed each other in a circle there is no origin, and one of them is named.
    """
    through = checkpointed(nodes.where(F.col("type") == passing).select(F.col("id").alias("src")))
    current = edges.select("dst", "dst_slot", "src", "src_slot")
    feed = checkpointed(edges.join(through.withColumnRenamed("src", "dst"), "dst", "left_semi").select(F.col("dst").alias("src"), F.col("src").alias("from"), F.col("src_slot").alias("from_slot")))
    step, most = 1, through.count()
    while step <= most:  # every round doubles the reach
        current = current.join(feed, "src", "left").select("dst", "dst_slot", F.coalesce("from", "src").alias("src"), F.coalesce("from_slot", "src_slot").alias("src_slot"))
        if feed.join(through.withColumnRenamed("src", "from"), "from", "left_semi").isEmpty():
            break
        up = feed.select(F.col("src").alias("from"), F.col("from").alias("f2"), F.col("from_slot").alias("s2"))
        feed = checkpointed(feed.join(up, "from", "left").select("src", F.coalesce("f2", "from").alias("from"), F.coalesce("s2", "from_slot").alias("from_slot")))
        step *= 2
    return current


def any_link_rows(links: DataFrame, key: str) -> DataFrame:
    """Links given as JSON, each a list [id, src, src_slot, dst, dst_slot, type] or an object with the same under names, as
    columns; others are left out. A type that isn't given is ``*``."""
    v = F.try_parse_json("link")
    number = lambda i, name: F.coalesce(F.try_variant_get(v, f"$[{i}]", "int"), F.try_variant_get(v, f"$.{name}", "int"))
    kind = F.coalesce(F.try_variant_get(v, "$[5]", "string"), F.nullif(F.try_variant_get(v, "$.type", "string"), F.lit("")), F.lit("*"))
    names = (("src", "origin_id"), ("src_slot", "origin_slot"), ("dst", "target_id"), ("dst_slot", "target_slot"))
    whole = F.try_variant_get(v, "$[4]", "int").isNotNull() | F.try_variant_get(v, "$.id", "int").isNotNull()
    rows = links.select(key, number(0, "id").alias("id"), *[F.coalesce(number(i, name), F.lit(0)).alias(c) for i, (c, name) in enumerate(names, 1)], kind.alias("type"), whole.alias("__whole"))
    return rows.where("__whole").drop("__whole")


def link_rows(links: DataFrame, key: str) -> DataFrame:
    """Links given as arrays [id, src, src_slot, dst, dst_slot, type] as columns."""
    at = lambda i: F.try_element_at("link", F.lit(i))
    return links.select(key, at(1).try_cast("int").alias("id"), at(2).try_cast("int").alias("src"), at(3).try_cast("int").alias("src_slot"), at(4).try_cast("int").alias("dst"), at(5).try_cast("int").alias("dst_slot"), at(6).alias("type"))


#: Rows of definitions that every task may get; more are joined by a shuffle.
_FEW = 100_000


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= _FEW else df


def _put_in_place(nodes: DataFrame, links: DataFrame, inner_nodes: DataFrame, inner_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs (columns ``g``) whose nodes of a type that is a ``sub`` of inner_nodes give way to its nodes; see expanded()."""
    inner_nodes, inner_links = _few(inner_nodes), _few(inner_links)
    subs = inner_nodes.select(F.col("sub").alias("type")).distinct()
    outer = nodes.join(subs, "type", "left_semi").select("g", F.col("id").alias("outer"), F.col("type").alias("sub"))
    name = lambda c: F.concat_ws("/", "outer", F.col(c))
    inside = outer.join(inner_links, "sub")
    both = inside.where("src <> '-10' and dst <> '-20'").select("g", name("src").alias("src"), "src_slot", name("dst").alias("dst"), "dst_slot")
    ins = inside.where("src = '-10' and dst <> '-20'").select("g", F.col("outer").alias("dst"), F.col("src_slot").alias("dst_slot"), name("dst").alias("__dst"), F.col("dst_slot").alias("__dst_slot"))
    outs = inside.where("dst = '-20' and src <> '-10'").select("g", F.col("outer").alias("src"), F.col("dst_slot").alias("src_slot"), name("src").alias("__src"), F.col("src_slot").alias("__src_slot"))
    entering = links.join(ins, ["g", "dst", "dst_slot"], "left").select("g", "src", "src_slot", F.coalesce("__dst", "dst").alias("dst"), F.coalesce("__dst_slot", "dst_slot").alias("dst_slot"))
    leaving = entering.join(outs, ["g", "src", "src_slot"], "left").select("g", F.coalesce("__src", "src").alias("src"), F.coalesce("__src_slot", "src_slot").alias("src_slot"), "dst", "dst_slot")
    gone = outer.select("g", F.col("outer").alias("id"))
    kept = leaving.join(gone.withColumnRenamed("id", "src"), ["g", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["g", "dst"], "left_anti")
    added = outer.join(inner_nodes, "sub").select("g", name("id").alias("id"), "type")
    return nodes.join(subs, "type", "left_anti").select("g", "id", "type").unionByName(added), kept.select("g", "src", "src_slot", "dst", "dst_slot").unionByName(both)


def flat_definitions(inner_nodes: DataFrame, inner_links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Definitions (sub, id, type) and (sub, src, src_slot, dst, dst_slot) without subgraphs in them, and the definitions
    (sub) that hold themselves, directly or through others, or hold one that does: these can't be flat and are left out.

    Bottom-up: a definition is put together once all that it holds are flat, so each is expanded once however often it is
    used, in as many rounds as definitions lie within one another.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    nodes = inner_nodes.select(F.col("sub").alias("g"), text("id"), "type").distinct()
    links = inner_links.select(F.col("sub").alias("g"), text("src"), "src_slot", text("dst"), "dst_slot")
    waiting = checkpointed(nodes.select("g").distinct())
    holds = checkpointed(nodes.join(waiting.withColumnRenamed("g", "type"), "type", "left_semi").select("g", "type").distinct())
    as_subs = lambda df: df.withColumnRenamed("g", "sub")
    flat_nodes, flat_links = nodes.where("false"), links.where("false")
    while True:
        ready = checkpointed(waiting.join(holds.join(waiting.withColumnRenamed("g", "type"), "type", "left_semi").select("g").distinct(), "g", "left_anti"))
        if ready.isEmpty():
            return as_subs(flat_nodes), as_subs(flat_links), as_subs(waiting)
        new_nodes, new_links = _put_in_place(nodes.join(ready, "g", "left_semi"), links.join(ready, "g", "left_semi"), as_subs(flat_nodes), as_subs(flat_links))
        flat_nodes, flat_links = checkpointed(flat_nodes.unionByName(new_nodes)), checkpointed(flat_links.unionByName(new_links))
        waiting = checkpointed(waiting.join(ready, "g", "left_anti"))


def expanded(nodes: DataFrame, links: DataFrame, inner_nodes: DataFrame, inner_links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs with their subgraphs put in place of the nodes that stand for them, however deep those lie within one another.

    Nodes (id string, type) whose type is a ``sub`` of inner_nodes (sub, id, type) give way to its nodes, named
    ``outer/inner``. Inner links (sub, src, src_slot, dst, dst_slot) from -10 are the outer node's inputs by slot, those to
    -20 its outputs. Links are (src, src_slot, dst, dst_slot). A node that stands for a definition that holds itself stays
    as it is; flat_definitions() reports those.
    """
    flat_nodes, flat_links, _ = flat_definitions(inner_nodes, inner_links)
    out_nodes, out_links = _put_in_place(nodes.withColumn("g", F.lit(0)), links.withColumn("g", F.lit(0)), flat_nodes, flat_links)
    return out_nodes.drop("g"), out_links.drop("g")


def executable(nodes: DataFrame, links: DataFrame, passing: str = "Reroute", skipped: tuple[str, ...] = ("Note", "MarkdownNote")) -> tuple[DataFrame, DataFrame]:
    """The nodes (id, type, mode) that run, and the links between them with pass-through nodes left out. Modes 2 and 4 are off."""
    runs = nodes.where(~F.col("type").isin(passing, *skipped) & ~F.coalesce("mode", F.lit(0)).isin(2, 4))
    ids = runs.select("id")
    direct = origins(nodes, links, passing)
    return runs, direct.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


# What a control behind a seed may say, what stands behind an uploaded picture, types of values that are typed in.
CONTROLS = ("fixed", "increment", "decrement", "randomize")
UPLOADS = ("image",)
WIDGETS = ("INT", "FLOAT", "STRING", "BOOLEAN", "COMBO")
VIDEO_ENDINGS = r"(?i)\.(mp4|webm|mov|mkv|avi|gif)$"


def is_widget(kind: Column, is_list: Column, forced: Column) -> Column:
    """Whether an input is typed in by a person rather than linked."""
    return ~F.coalesce(forced, F.lit(False)) & (F.coalesce(is_list, F.lit(False)) | kind.isin(*WIDGETS))


def input_names(required: Column, optional: Column) -> Column:
    """Names of a node's inputs, the required ones first, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(required, none), F.coalesce(optional, none)))


def found_input(inputs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """For each wanted name (key, name) the first input (key, ord, input) that has it, or whose name ends with it after a dot, or
    the other way round."""
    same = (F.col("input") == F.col("name")) | F.endswith("input", F.concat(F.lit("."), "name")) | F.endswith("name", F.concat(F.lit("."), "input"))
    return wanted.join(inputs.select(key, "ord", "input"), key).where(same).groupBy(key, "name").agg(F.min_by("input", "ord").alias("input"))


def widget_values(specs: DataFrame, widgets: DataFrame, key: str) -> DataFrame:
    """Values of a node's inputs by position: (key, name, value).

    ``specs`` are (key, ord, name, widget, linked, converted, control, upload): inputs that aren't typed in take no value, a
    linked one takes one only if it was ``converted`` from a typed one, and gives none. A control or the mark of an upload
    behind a value is passed over. ``widgets`` are (key, values). What an input takes is told by those before it, so each
    node's inputs are folded in order; a node has a bounded number of them.
    """
    spec = F.struct("ord", "name", "widget", "linked", "converted", "control", "upload")
    rows = specs.groupBy(key).agg(F.array_sort(F.collect_list(spec)).alias("__specs")).join(widgets.select(key, F.col("values").alias("__values")), key)
    at = lambda acc, n=0: F.get("__values", acc["i"] + n)
    is_in = lambda value, words: F.coalesce(value.isin(*words), F.lit(False))

    def take(acc: Column, s: Column) -> Column:
        has = acc["i"] < F.size("__values")
        takes = has & F.when(s["linked"], s["converted"]).otherwise(s["widget"])
        after = acc["i"] + 1
        control = (s["control"] | s["linked"]) & is_in(F.get("__values", after), CONTROLS)
        after = after + control.cast("int")
        upload = s["upload"] & ~s["linked"] & is_in(F.get("__values", after), UPLOADS)
        after = after + upload.cast("int")
        out = F.when(takes & ~s["linked"], F.array_append(acc["out"], F.struct(s["name"].alias("name"), at(acc).alias("value")))).otherwise(acc["out"])
        return F.struct(F.when(takes, after).otherwise(acc["i"]).alias("i"), out.alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.array().cast("array<struct<name:string,value:string>>").alias("out"))
    return rows.select(key, F.explode(F.aggregate("__specs", start, take, lambda acc: acc["out"])).alias("x")).select(key, "x.name", "x.value")


def node_inputs(nodes: DataFrame, links: DataFrame, sockets: DataFrame, values: DataFrame, passing: str = "Reroute") -> DataFrame:
    """The inputs of the nodes that run: (node, name, src, src_slot, value).

    ``sockets`` are (node, slot, name), ``values`` (node, name, value) as widget_values() gives them. A linked input has its
    true origin, any other one its value; nodes that don't run have none.
    """
    runs, direct = executable(nodes, links, passing)
    linked = direct.join(sockets.select(F.col("node").alias("dst"), F.col("slot").alias("dst_slot"), "name"), ["dst", "dst_slot"]).select(F.col("dst").alias("node"), "name", "src", "src_slot")
    typed = values.join(runs.select(F.col("id").alias("node")), "node", "left_semi").join(linked.select("node", "name"), ["node", "name"], "left_anti")
    return linked.unionByName(typed, allowMissingColumns=True)


def unknown_types(nodes: DataFrame, known: DataFrame, most: int = 8) -> DataFrame:
    """The first ``most`` types of a graph's nodes, in order, that aren't known: (graph, types)."""
    missing = nodes.select("graph", "type").distinct().join(known.select("type").distinct(), "type", "left_anti")
    return missing.groupBy("graph").agg(F.slice(F.array_sort(F.collect_set("type")), 1, most).alias("types"))


def subgraph_index(workflows: DataFrame, document: str = "document") -> DataFrame:
    """Definitions of subgraphs in workflow documents (graph, document), given as a list or under names: (graph, sub, definition)."""
    v = F.try_parse_json(document)
    listed = F.transform(F.try_variant_get(v, "$.definitions.subgraphs", "array<variant>"), lambda d: F.struct(F.try_variant_get(d, "$.id", "string").alias("sub"), F.to_json(d).alias("definition")))
    named = F.transform(F.map_entries(F.try_variant_get(v, "$.definitions.subgraphs", "map<string,variant>")), lambda e: F.struct(F.coalesce(F.try_variant_get(e["value"], "$.id", "string"), e["key"]).alias("sub"), F.to_json(e["value"]).alias("definition")))
    return workflows.select("graph", F.explode(F.coalesce(listed, named)).alias("d")).select("graph", "d.*").where("sub is not null")


def patched(nodes: DataFrame, rules: list[tuple[Column, dict[int, Column]]]) -> DataFrame:
    """Nodes (type, title, widgets) with values put in: the first rule that fits a node gives values by position, and what lies
    beyond the node's own values is appended."""

    def with_values(values: dict[int, Column]) -> Column:
        longest = F.greatest(F.size("widgets"), *[F.lit(i + 1) for i in values], F.lit(0))
        put = lambda i: reduce(lambda acc, kv: F.when(i == kv[0], kv[1].cast("string")).otherwise(acc), values.items(), F.get("widgets", i))
        return F.transform(F.sequence(F.lit(0), longest - 1), put)

    out = F.col("widgets")
    for fits, values in reversed(rules):
        out = F.when(F.coalesce(fits, F.lit(False)), with_values(values)).otherwise(out)
    return nodes.withColumn("widgets", out)


def standard_rules(prompt: Column, seconds: Column, steps: Column, seed: Column, prefix: Column, aspect: Column, megapixels: Column, image: Column, video_types: tuple[str, ...]) -> list[tuple[Column, dict[int, Column]]]:
    """Which values of a run go into which nodes, by type and title."""
    kind, title, some = F.col("type"), F.lower(F.coalesce("title", F.lit(""))), F.size("widgets") > 0
    return [
        (kind.isin(*video_types), {0: prompt}),
        ((kind == "PrimitiveStringMultiline") & F.contains(title, F.lit("prompt")), {0: prompt}),
        ((kind == "PrimitiveFloat") & F.contains(title, F.lit("duration")), {0: seconds}),
        ((kind == "PrimitiveInt") & F.contains(title, F.lit("step")), {0: steps}),
        ((kind == "BasicScheduler") & (F.size("widgets") >= 2), {1: steps}),
        ((kind == "ResolutionSelector") & (F.size("widgets") >= 2), {0: aspect, 1: megapixels}),
        ((kind == "RandomNoise") & some, {0: seed, 1: F.lit("fixed")}),
        ((kind == "SaveVideo") & some, {0: prefix}),
        ((kind == "LoadImage") & image.isNotNull(), {0: image, 1: F.lit("image")}),
    ]


def subgraph_rule(prompt: Column, seconds: Column, steps: Column, seed: Column) -> tuple[Column, dict[int, Column]]:
    """The rule for a node that stands for a subgraph with steps (``input_names``): the prompt first, then from the fourth on."""
    names = F.transform("input_names", lambda x: F.lower(x))
    numbers = F.get("widgets", F.lit(3)).try_cast("double").isNotNull() & F.get("widgets", F.lit(4)).try_cast("double").isNotNull()
    keep = lambda i, value: F.when((F.size("widgets") >= 6) & numbers, value.cast("string")).otherwise(F.get("widgets", F.lit(i)))
    return (F.size("widgets") >= 5) & F.array_contains(names, "steps"), {0: prompt, 3: keep(3, seconds), 4: keep(4, steps), 5: keep(5, seed)}


def video_files(outputs: DataFrame) -> DataFrame:
    """Files (kind, filename, ...) of a run's outputs that are videos, by kind or by ending."""
    return outputs.where((F.col("kind") == "videos") | (F.col("kind").isin("gifs", "images", "files") & F.coalesce(F.col("filename"), F.lit("")).rlike(VIDEO_ENDINGS)))


def run_error(status: Column, messages: Column) -> Column:
    """The first message of a run that failed (``messages`` of name and text), a plain one if it has none; NULL if it didn't."""
    broke = (F.coalesce(status, F.lit("")) == "error") | F.exists(F.coalesce(messages, F.array().cast("array<struct<name:string,text:string>>")), lambda m: F.coalesce(m["name"] == "execution_error", F.lit(False)))
    said = F.transform(F.filter(messages, lambda m: F.trim(F.coalesce(m["text"], F.lit(""))) != ""), lambda m: F.trim(m["text"]))
    return F.when(broke, F.coalesce(F.get(said, F.lit(0)), F.lit("the run failed")))


def run_over(completed: Column, status: Column, messages: Column) -> Column:
    """Whether a run is over, well or not."""
    return F.coalesce(completed, F.lit(False)) | run_error(status, messages).isNotNull()
