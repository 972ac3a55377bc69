"""Lookups, best matches, range joins and reconciliations.

Small sides are never broadcast by hint: the planner does it where their
measured size allows, and sort-merge joins serve beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnbase.functions.similarity import char_jaccard, dice, text_overlap


def enabled_apps(configs: DataFrame, apps: DataFrame, key: str, override: str) -> DataFrame:
    """Apps with a feature switched on: config joined to app, the latest scene by id looked up, or switched on by the override; distinct. configs: id, app_id, client, config_key, config_value, is_enabled, del_flag; apps: id, customer, is_enabled, del_flag."""
    live = configs.where("coalesce(del_flag, 0) = 0")
    scene = live.where(F.col("config_key") == "scene").groupBy("app_id").agg(F.max_by("config_value", "id").alias("scene"))
    forced = live.where((F.col("config_key") == override) & (F.col("is_enabled") == 1)).select("app_id").distinct().withColumn("forced", F.lit(True))
    on = live.where(F.col("config_key") == key).select("app_id", "client", "is_enabled")
    own = apps.where("is_enabled = 1 and coalesce(del_flag, 0) = 0").select(F.col("id").alias("app_id"), "customer")
    t = on.join(own, "app_id").join(scene, "app_id", "left").join(forced, "app_id", "left")
    return t.where((F.col("is_enabled") == 1) | F.col("forced")).select("app_id", "client", "customer", "scene").distinct()


def chain_lookup(rows: DataFrame, by_id: DataFrame, by_path: DataFrame, id_col: str, path_col: str) -> DataFrame:
    """Category chain by id, else by full path; null if neither is known. by_id: key, chain; by_path: key, chain."""
    a = by_id.select(F.col("key").alias("__i"), F.col("chain").alias("__ci"))
    b = by_path.select(F.col("key").alias("__p"), F.col("chain").alias("__cp"))
    t = rows.join(a, F.col(id_col) == F.col("__i"), "left").join(b, F.col(path_col) == F.col("__p"), "left")
    return t.withColumn("chain", F.coalesce("__ci", "__cp")).drop("__i", "__ci", "__p", "__cp")


def best_category(rows: DataFrame, candidates: str, chains: DataFrame, key: str) -> DataFrame:
    """The best scored candidate whose chain is known; ties to the earlier. candidates: array of struct with category_id, score."""
    t = rows.select(key, F.posexplode(candidates).alias("pos", "c")).select(key, "pos", "c.*")
    t = t.join(chains.select(F.col("key").alias("category_id"), "chain"), "category_id")
    best = t.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "pos"))).where("r = 1")
    return rows.join(best.select(key, "category_id", "score", "chain"), key, "left")


def infer_category(rows: DataFrame, tree: DataFrame, key: str, explicit: str, tags: str, title: str, words: int = 4) -> DataFrame:
    """Category by the name of its leaf: the platform named outright beats a tag, a tag beats the title; ties go to the longer path, then to the later one. tree: path, leaf.

    Candidates come from an equi join on the names' words, not from all
    pairs: names are looked up by runs of up to `words` words.
    """
    from tarnbase.functions.text import text

    def runs(x: Column) -> Column:
        w = F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), lambda s: s != "")
        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))

        return F.array_distinct(F.flatten(F.array(*map(of, range(1, words + 1)))))

    def scored(score: int, found: Column) -> Column:
        return F.transform(found, lambda n: F.struct(F.lit(score).alias("score"), n.alias("name")))

    sources = ((300, F.array(F.array_join(F.filter(F.split(F.lower(text(explicit)), r"[^\p{L}\p{N}]+"), lambda s: s != ""), " "))), (200, F.flatten(F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), runs))), (100, runs(text(title))))
    names = F.flatten(F.array(*[scored(s, a) for s, a in sources]))
    hits = rows.select(key, F.explode(F.array_distinct(names)).alias("h")).select(key, "h.*").where("name <> ''")
    leaf = tree.select("path", "leaf", F.array_join(F.filter(F.split(F.lower("leaf"), r"[^\p{L}\p{N}]+"), lambda s: s != ""), " ").alias("name"))
    best = hits.join(leaf, "name").groupBy(key).agg(F.max(F.struct("score", F.length("path").alias("n"), "path", "leaf")).alias("b"))
    return rows.join(best.select(key, F.col("b.score").alias("score"), F.col("b.path").alias("category_path"), F.col("b.leaf").alias("category_name")), key, "left")


def speaker_identity(messages: DataFrame, identities: DataFrame, id_keys: list[str], name_keys: list[str], key: str) -> DataFrame:
    """Identity of the speaker by the first id key that is known, else by the first name key; the highest priority wins per key. identities: key_type (id, name), key, role, priority."""
    best = identities.groupBy(F.col("key_type").alias("__kt"), F.col("key").alias("__k")).agg(F.max_by("role", F.struct("priority", "role")).alias("role"))
    probes = [F.struct(F.lit(i).alias("ord"), F.lit("id" if c in id_keys else "name").alias("__kt"), F.col(c).cast("string").alias("__k")) for i, c in enumerate([*id_keys, *name_keys])]
    t = messages.select(key, F.explode(F.array(*probes)).alias("p")).select(key, "p.*").where("__k is not null and __k <> ''")
    hit = t.join(best, ["__kt", "__k"]).groupBy(key).agg(F.min_by("role", "ord").alias("role"))
    return messages.join(hit, key, "left")


def names_match(a: Column, b: Column) -> Column:
    """Equal after normalisation, or one in the other."""
    from tarnbase.functions.text import name_key

    x, y = name_key(a), name_key(b)
    return (x != "") & (y != "") & ((x == y) | x.contains(y) | y.contains(x))


def align_queries(peer: DataFrame, local: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Each peer query with its local match: equal keys first (the first local one), else the best character Dice from the threshold up; ties to the first.

    peer: key, norm; local: ord, query, norm. The measure sees sets of
    characters, so texts of one set are compared once, by their first. Fuzzy
    candidates share a rare character: two sets with Dice >= t share at least
    t/(2-t) of the larger, so one of the rarest |A| - ceil(t/(2-t)|A|) + 1
    characters of the peer's set must be on the local side; rarity is counted
    over the local sets.
    """
    from tarnbase.functions.lineage import cut
    from tarnbase.functions.similarity import chars

    first = local.groupBy("norm").agg(F.min_by("query", "ord").alias("query"), F.min("ord").alias("ord"))
    exact = peer.join(first.select("norm", F.col("query").alias("local_query")), "norm", "left")
    sets = cut(first.withColumn("cs", F.array_sort(chars("norm"))).groupBy("cs").agg(F.min_by("query", "ord").alias("query"), F.min("ord").alias("ord")))
    wanted = exact.where("local_query is null").select(F.array_sort(chars("norm")).alias("pcs")).where("size(pcs) > 0").distinct()
    need = threshold / (2 - threshold)
    rare = sets.select(F.explode("cs").alias("c")).groupBy("c").agg(F.count("*").alias("df"))
    pc = wanted.select("pcs", F.explode("pcs").alias("c")).join(rare, "c", "left").groupBy("pcs").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "c"))).alias("o"))
    probe = F.slice("o", 1, F.greatest(F.size("o") - F.ceil(F.size("o") * need).cast("int") + 1, F.lit(1)))
    cand = pc.select("pcs", F.explode(probe).alias("p")).select("pcs", F.col("p.c").alias("c")).join(sets.select("cs", "ord", "query", F.explode("cs").alias("c")), "c").select("pcs", "cs", "ord", "query").distinct()
    scored = cand.withColumn("dice", dice("pcs", "cs")).where(F.col("dice") >= threshold)
    best = scored.groupBy("pcs").agg(F.max_by(F.struct("query", "dice"), F.struct("dice", -F.col("ord"))).alias("b"))
    t = exact.withColumn("pcs", F.array_sort(chars("norm"))).join(best, "pcs", "left")
    kind = F.when(F.col("local_query").isNotNull(), "exact").when(F.col("b").isNotNull(), "fuzzy").otherwise("none")
    return t.select("key", "norm", kind.alias("match_type"), F.coalesce("local_query", "b.query", F.lit("")).alias("local_query"), F.when(kind == "exact", 1.0).otherwise(F.coalesce("b.dice", F.lit(0.0))).alias("similarity"))


def history_match(pairs: DataFrame, history: DataFrame, before: int = 5, after: int = 10, threshold: float = 0.8) -> DataFrame:
    """Question-answer pairs to where they were said: messages like the question, then the best answer within [-before, +after) of each. pairs: key, grp, q, a; history: grp, pos, content."""
    q = pairs.join(history.select("grp", F.col("pos").alias("qpos"), F.col("content").alias("qc")), "grp").withColumn("qs", text_overlap("q", "qc")).where(F.col("qs") >= threshold)
    h = history.select(F.col("grp").alias("g2"), "pos", "content")
    near = q.join(h, (F.col("grp") == F.col("g2")) & F.col("pos").between(F.col("qpos") - before, F.col("qpos") + after - 1))
    near = near.withColumn("as", text_overlap("a", "content"))
    return near.groupBy("key").agg(F.max_by(F.struct("qpos", "pos", "as"), F.struct("as", "qs", -F.col("pos"))).alias("m")).select("key", "m.*").where(F.col("as") >= threshold)


def answer_speaker(answers: DataFrame, lines: DataFrame, least: float = 0.6) -> DataFrame:
    """The line that says an answer best, by Jaccard of characters against lines cut to twice its length plus 40. answers: key, grp, answer; lines: grp, pos, speaker, content."""
    t = answers.join(lines, "grp")
    t = t.withColumn("s", char_jaccard(F.col("answer"), F.substring(F.col("content"), F.lit(1), 2 * F.length("answer") + 40)))
    best = t.groupBy("key").agg(F.max_by(F.struct("speaker", "pos", "s"), F.struct("s", -F.col("pos"))).alias("b")).select("key", "b.*").where(F.col("s") >= least)
    return answers.join(best, "key", "left")


def retire_plan(snapshot: DataFrame, state: DataFrame, new_since: str | None = None, key: str = "id") -> DataFrame:
    """What to do with each id of a snapshot: missing, already_del, overwritten (inserted since), or delete. state: id, del_flag, insert_time."""
    s = state.select(F.col(key).alias("__k"), "del_flag", "insert_time")
    t = snapshot.select(key).distinct().join(s, F.col(key) == F.col("__k"), "left")
    newer = F.coalesce(F.col("insert_time"), F.lit("")) >= new_since if new_since else F.lit(False)
    action = F.when(F.col("__k").isNull(), "missing").when(F.coalesce("del_flag", F.lit(0)) != 0, "already_del").when(newer, "overwritten").otherwise("delete")
    return t.select(key, action.alias("action"))


def source_status(names: DataFrame, docs: DataFrame, name_col: str = "source_name", file_col: str = "from_file_name") -> DataFrame:
    """Verdict on each source file: never_indexed, all_deleted, partial_deleted or ok."""
    n = lambda c: F.count(F.when(c, 1))
    per = docs.groupBy(F.col(file_col).alias("__f")).agg(n(F.coalesce("del_flag", F.lit(0)) == 0).alias("active"), n(F.col("del_flag") == 1).alias("deleted"))
    t = names.select(name_col).distinct().join(per, F.col(name_col) == F.col("__f"), "left").drop("__f").fillna(0, ["active", "deleted"])
    v = F.when((F.col("active") == 0) & (F.col("deleted") == 0), "never_indexed").when(F.col("active") == 0, "all_deleted").when(F.col("deleted") > 0, "partial_deleted").otherwise("ok")
    return t.withColumn("verdict", v)


def split_by_status(rows: DataFrame, status: DataFrame, file_col: str) -> DataFrame:
    """rows with keep: not if the source file is wholly deleted. Rows without a file are kept."""
    gone = status.where("verdict = 'all_deleted'").select(F.col(status.columns[0]).alias("__f"), F.lit(False).alias("__keep"))
    return rows.join(gone, F.col(file_col) == F.col("__f"), "left").withColumn("keep", F.coalesce("__keep", F.lit(True))).drop("__f", "__keep")


def duplicate_candidates(new: DataFrame, existing: DataFrame, top: int = 5, exclude_self: bool = True) -> DataFrame:
    """The nearest stored documents of each new one of the same type and platform. Both: id, data_type, platform, vec."""
    from tarnbase.operators.search import cosines

    t = cosines(existing.select("id", "vec", "data_type", "platform"), new.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "data_type", "platform"), top + exclude_self, by=("data_type", "platform"))
    t = t.select(F.col("qid").alias("id"), F.col("id").alias("other"), F.col("cosine").alias("similarity"))
    if exclude_self:
        t = t.where("id <> other")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def duplicate_links(docs: DataFrame, basic: float = 0.7, strict: float = 0.95, judge: Column | None = None) -> DataFrame:
    """Of every document the number of others of the same type and platform that hold the same knowledge, and the smallest id among them and itself. docs: id, data_type, platform, vec. Pairs are compared in blocks; only those from `basic` up leave a block. judge: what an injected model says of (id, other, similarity) between the bounds."""
    from tarnbase.operators.search import cosines

    own = ("data_type", "platform")
    t = cosines(docs.select("id", "vec", *own), docs.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), *own), least=basic if judge is not None else max(basic, strict), by=own)
    t = t.select(F.col("qid").alias("id"), F.col("id").alias("other"), F.col("cosine").alias("similarity")).where("id <> other")
    same = F.col("similarity") > strict
    t = t.where(same if judge is None else same | judge).groupBy("id").agg(F.count("*").alias("n"), F.min("other").alias("least"))
    return docs.select("id").join(t, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_links"), F.least("id", "least").alias("first"))


def merge_routes(*routes: DataFrame, key: str = "id", fill: tuple[str, ...] = ()) -> DataFrame:
    """Hits of several routes: one row per key from the first route that has it, missing fields filled from later ones, and the routes that found it."""
    both = None
    for i, r in enumerate(routes):
        t = r.withColumn("__route", F.lit(i))
        both = t if both is None else both.unionByName(t, allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "__route")]
    pick = [(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__route"))) if c in fill else F.min_by(c, "__route")).alias(c) for c in cols]
    return both.groupBy(key).agg(*pick, F.min("__route").alias("route"), F.array_sort(F.collect_set("__route")).alias("routes"))


def best_of_variants(hits: DataFrame, key: str = "id", score: str = "similarity", variant: str = "variant") -> DataFrame:
    """Hits of several wordings of a query: the best similarity of each document and the wordings that found it."""
    return hits.groupBy(key).agg(F.max(score).alias(score), F.array_join(F.sort_array(F.collect_set(F.col(variant).cast("string"))), ",").alias("variants"))


def page_images(ranges: DataFrame, images: DataFrame, key: str = "id", width: int = 16) -> DataFrame:
    """Pictures on the pages of a range of the same file, once per content. ranges: id, file, start_page, end_page; images: file, page_no, md5. Ranges are cut into cells of `width` pages, so it is an equi join."""
    r = ranges.withColumn("cell", F.explode(F.expr(f"sequence(start_page div {width}, end_page div {width})")))
    i = images.withColumn("cell", F.expr(f"page_no div {width}")).withColumnRenamed("file", "file2").withColumnRenamed("cell", "cell2")
    t = r.join(i, (F.col("file") == F.col("file2")) & (F.col("cell") == F.col("cell2"))).where("page_no between start_page and end_page")
    return t.groupBy(key, "md5").agg(F.min("page_no").alias("page_no"))


def verified_labels(rows: DataFrame, labels: DataFrame, least: float = 0.9) -> DataFrame:
    """Labels joined back by position, where the question echoed with them is the row's. rows: idx, q; labels: idx, question, tags."""
    t = rows.join(labels.select("idx", "question", F.col("tags").alias("__t")), "idx", "left")
    ok = char_jaccard("q", "question") >= least
    return t.withColumn("tags", F.when(ok, F.col("__t"))).drop("__t", "question")


def remap_by_hash(new: DataFrame, old: DataFrame) -> DataFrame:
    """Paths of newly parsed pictures to the old ones with the same content. Both: path, md5."""
    o = old.groupBy("md5").agg(F.min("path").alias("old_path"))
    return new.join(o, "md5", "left").withColumn("path", F.coalesce("old_path", "path")).drop("old_path")


def sheet_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Cells that differ between two workbooks, by sheet and row; rows that only one has count as differing in all columns. Sheets that only one has are left out. Both: sheet, row_no, and the columns."""
    common = a.select("sheet").intersect(b.select("sheet"))
    x = a.join(common, "sheet", "left_semi").select("sheet", "row_no", *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    y = b.join(common, "sheet", "left_semi").select("sheet", "row_no", *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    t = x.join(y, ["sheet", "row_no"], "full")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").alias("old"), F.col(f"b_{c}").alias("new")) for c in columns])
    return t.select("sheet", "row_no", F.explode(F.filter(cells, lambda z: ~z["old"].eqNullSafe(z["new"]))).alias("d")).select("sheet", "row_no", "d.*")


def merge_word_lists(a: DataFrame, b: DataFrame, key: str = "platform") -> DataFrame:
    """Union of the word arrays of two tables by platform."""
    none = F.array().cast("array<string>")
    t = a.select(key, F.col("words").alias("wa")).join(b.select(key, F.col("words").alias("wb")), key, "full")
    return t.select(key, F.array_union(F.coalesce("wa", none), F.coalesce("wb", none)).alias("words"))


def fill_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Category ids and names each filled from the other. names: id, name."""
    i = names.select(F.col("id").alias("__id"), F.col("name").alias("__n1")).dropDuplicates(["__id"])
    n = names.groupBy(F.col("name").alias("__nm")).agg(F.min("id").alias("__i2"))
    t = rows.join(i, F.col("category_id") == F.col("__id"), "left").join(n, F.col("category_name") == F.col("__nm"), "left")
    return t.withColumn("category_name", F.coalesce("category_name", "__n1")).withColumn("category_id", F.coalesce("category_id", "__i2")).drop("__id", "__n1", "__nm", "__i2")


def deepest_category(rows: DataFrame, paths: DataFrame, sep: str = "-") -> DataFrame:
    """The deepest known path of platform and site: platform-site, else platform. paths: path, category_id."""
    p = paths.dropDuplicates(["path"])
    t = rows.withColumn("__a", F.concat_ws(sep, "platform", "site"))
    t = t.join(p.select(F.col("path").alias("__a"), F.col("category_id").alias("__ia")), "__a", "left").join(p.select(F.col("path").alias("platform"), F.col("category_id").alias("__ib")), "platform", "left")
    return t.withColumn("category_path", F.when(F.col("__ia").isNotNull(), F.col("__a")).when(F.col("__ib").isNotNull(), F.col("platform"))).withColumn("category_id", F.coalesce("__ia", "__ib")).drop("__a", "__ia", "__ib")


def reconcile(exported: DataFrame, stored: DataFrame, key: str = "index_name") -> DataFrame:
    """Counts of an export against the store, per index."""
    t = exported.groupBy(key).agg(F.count("*").alias("exported")).join(stored.groupBy(key).agg(F.count("*").alias("stored")), key, "full").fillna(0, ["exported", "stored"])
    return t.withColumn("difference", F.col("stored") - F.col("exported"))
