"""The engine's commands over a work folder of tables.

Each command can run again after a failure: what an ingest takes is written to a partition named after its batches, so
a repeated one replaces itself; of several answers to a unit the last counts; batches are taken whole or not at all, and
roles follow from the detected direction alone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import text as T
from quillgrid.operators import batching, checks, glossary, jobs, package_checks, provider, render_ooxml, rendering, responses, roles
from quillgrid.sources import ooxml, package_source
from quillgrid.sources.delivery import deliver
from quillgrid.streaming.ingest import answered

PHASES = ("analysis", "translation", "review")


class Engine:
    def __init__(self, spark: SparkSession, work: str):
        self.spark, self.work = spark, work.rstrip("/")

    def _path(self, name: str) -> str:
        return f"{self.work}/{name}"

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """A table of the work folder; with a schema, an absent one is empty."""
        try:
            return self.spark.read.parquet(self._path(name))
        except AnalysisException as e:
            if schema is None or e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _put(self, name: str, ingest: str, df: DataFrame) -> None:
        df.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{self._path(name)}/ingest={ingest}")

    def prepare(self, inputs: str) -> DataFrame:
        """Read Word and Excel packages; writes units and a manifest, which it returns. Other files, and packages that can't
        be read, are listed as rejected with what is wrong."""
        files = ooxml.packages(self.spark, inputs)
        own = files.where("error IS NULL").select("doc_id", ooxml.read(F.col("content"), lines=True).alias("r"))
        read = self._kept("read", own.select("doc_id", F.col("r.lines").alias("lines"), F.col("r.error").alias("broken")))
        broken = read.where("broken IS NOT NULL").select("doc_id", "broken")
        files.join(broken, "doc_id", "left").withColumn("error", F.coalesce("error", "broken")).drop("broken").write.mode("overwrite").parquet(self._path("files"))
        read.select("doc_id", F.posexplode("lines").alias("idx", "l")).select("doc_id", "idx", "l.*").write.mode("overwrite").parquet(self._path("lines"))
        return self.refresh_roles()

    def prepare_streamed(self, inputs: str, **options) -> DataFrame:
        """As ``prepare``, part by part through the data source ``packages``, for packages too large for one task."""
        package_source.register(self.spark)
        broken = self.spark.read.format("packages").options(kind="error", **options).load(inputs)
        errors = broken.groupBy("doc_id").agg(F.min("error").alias("broken"))
        files = ooxml.packages(self.spark, inputs).join(errors, "doc_id", "left")
        files.withColumn("error", F.coalesce("error", "broken")).drop("broken").write.mode("overwrite").parquet(self._path("files"))
        good = self.read("files").where("error IS NULL").select("doc_id")
        package_source.lines(self.spark, inputs, **options).join(good, "doc_id", "left_semi").write.mode("overwrite").parquet(self._path("lines"))
        return self.refresh_roles()

    def prepare_lines(self, lines: DataFrame) -> DataFrame:
        """As ``prepare``, for lines (doc_id, idx, text) from any table."""
        lines.select("doc_id", "idx", "text", F.lit("text").alias("part"), F.col("idx").cast("string").alias("place")).write.mode("overwrite").parquet(self._path("lines"))
        return self.refresh_roles()

    def refresh_roles(self, skip_rows: str | None = None) -> DataFrame:
        """Work out roles again; rows to skip of Excel cells are applied after them, each time.

        The rows to skip are fixed by the first call that names any: another specification, one for a job that has answers
        already, and one for inputs without Excel cells are refused.
        """
        lines = self.read("lines")
        skip_rows = self._skipped(lines, skip_rows)
        units = roles.with_roles(roles.units_of(lines.select("doc_id", "idx", "text")))
        units = units.join(lines.select("doc_id", F.col("idx").cast("long").alias("unit_ord"), "part", "place"), ["doc_id", "unit_ord"])
        if skip_rows:
            row = F.when(F.startswith("part", F.lit("xl/")), F.expr(r"try_cast(regexp_extract(place, '([1-9][0-9]*)$', 1) AS bigint)"))
            units = roles.without_rows(units, skip_rows, F.coalesce(row, F.lit(0)))
        units.write.mode("overwrite").parquet(self._path("units"))
        return roles.manifest(self.read("units"))

    def _skipped(self, lines: DataFrame, spec: str | None) -> str | None:
        """The rows to skip that hold for this job."""
        was = self.read("skipped", "spec string").first()
        if spec is None or not spec.strip():
            return was and was["spec"]
        spec = ",".join(t.replace(" ", "") for t in spec.split(",") if t.strip())
        if was and was["spec"] != spec:
            raise ValueError(f"this job leaves out the rows {was['spec']}; start another one for {spec}")
        if not was:
            if not lines.where(F.startswith("part", F.lit("xl/"))).limit(1).count():
                raise ValueError("rows can be left out of Excel inputs only")
            if self.read("events", "doc_id string, phase string, id string").limit(1).count():
                raise ValueError("rows can be left out before the first answer only")
            named = self.spark.createDataFrame([(spec,)], "spec string")
            named.select(roles.row_ranges(F.col("spec"))).first()  # a bad range raises before anything is stored
            named.write.mode("overwrite").parquet(self._path("skipped"))
        return spec

    def _events(self) -> DataFrame:
        kind = dict(self.read("units").dtypes)["doc_id"]
        return self.read("events", f"doc_id {kind}, phase string, id string")

    def _open_units(self, phase: str) -> tuple[DataFrame, DataFrame, dict]:
        """Units of documents whose gate for the phase is open, events of the phase, and what prompts need besides."""
        if phase not in PHASES:
            raise ValueError(f"phase must be one of {', '.join(PHASES)}")
        units, events = self.read("units"), self._events()
        gates = jobs.gates(jobs.progress(units, events))
        gate = {"analysis": F.lit(True), "translation": F.col("can_lock"), "review": F.col("can_review")}[phase]
        own = units.join(gates.where(gate).select("doc_id"), "doc_id", "left_semi")
        more = {}
        if phase != "analysis":
            more["terms"] = self.read("glossary", "source string, target string, direction string, ord bigint")
        if phase == "review":
            more["targets"] = self.targets()
        return own, events.where(F.col("phase") == phase), more

    def next_batches(self, phase: str, limit: int = batching.LIMIT, chars: int = batching.CHARS) -> DataFrame:
        """The open batch of each document whose gate for the phase is open; ``phase_states`` tells why a document has none."""
        if limit < 1 or chars < 1000:
            raise ValueError("limit must be at least 1 and chars at least 1000")
        own, done, more = self._open_units(phase)
        return batching.next_batches(own, phase, done, limit, chars, **more)

    def phase_states(self, phase: str) -> DataFrame:
        """(doc_id, state) of a phase: ``open``, ``complete``, or ``waiting`` for an earlier phase."""
        if phase not in PHASES:
            raise ValueError(f"phase must be one of {', '.join(PHASES)}")
        done = {"analysis": "analysis", "translation": "translations", "review": "reviews"}[phase]
        rows = jobs.progress(self.read("units"), self._events())
        both = rows.join(jobs.gates(rows).select("doc_id", "can_lock", "can_review"), "doc_id")
        gate = {"analysis": F.lit(True), "translation": F.col("can_lock"), "review": F.col("can_review")}[phase]
        return both.select("doc_id", F.when(~gate, "waiting").when(F.col(done) >= F.col("total"), "complete").otherwise("open").alias("state"))

    def open_batches(self, phase: str, limit: int = batching.LIMIT, chars: int = batching.CHARS, long: bool = False) -> DataFrame:
        """All open batches of such documents, packed once; ``long`` packs each document in blocks, for very long ones."""
        if limit < 1 or chars < 1000:
            raise ValueError("limit must be at least 1 and chars at least 1000")
        own, done, more = self._open_units(phase)
        return batching.payloads(batching.pending(own, done), phase, limit, chars, long=long, **more)

    def ingest(self, phase: str, payloads: DataFrame, raw: DataFrame) -> DataFrame:
        """Take raw answers (doc_id, batch_no, content) to batches; returns the verdict on each batch."""
        units = self.read("units")
        name = payloads.select(F.xxhash64("doc_id", "batch_no", "ids").alias("h")).agg(F.bit_xor("h"), F.count(F.lit(1))).first()
        ingest = f"{phase}-{(name[0] or 0) & (1 << 64) - 1:016x}-{name[1]}"
        ids = payloads.select("doc_id", "batch_no", F.explode(F.split("ids", r"\|")).alias("id"))
        items = ids.join(units.select("doc_id", "id", "source_hash"), ["doc_id", "id"])
        got = answered(raw)
        if phase == "translation":
            verdicts = responses.verdicts(items, got)
            self._put("translations", ingest, responses.accepted_translations(items, got))
        elif phase == "review":
            verdicts = responses.id_differences(items, got).withColumn("accepted", (F.col("missing") == "") & (F.col("extra") == ""))
            self._put("corrections", ingest, responses.corrections(got.join(verdicts.where("accepted"), ["doc_id", "batch_no"], "left_semi")))
        else:
            parsed = F.from_json(T.extract_json("content"), f"struct<terms:array<{glossary.TERM}>>")
            verdicts = raw.select("doc_id", "batch_no", parsed.alias("a")).withColumn("accepted", F.col("a.terms").isNotNull())
            terms = responses.terms_of(verdicts.where("accepted").select(F.xxhash64("doc_id", "batch_no").alias("ord"), F.col("a.terms").alias("terms")))
            self._put("terms", ingest, terms.withColumn("src_rank", F.lit(1)))
            verdicts = verdicts.select("doc_id", "batch_no", "accepted")
        good = items.join(verdicts.where("accepted"), ["doc_id", "batch_no"], "left_semi")
        self._put("events", ingest, good.select("doc_id", F.lit(phase).alias("phase"), "id"))
        return verdicts

    def lock_glossary(self, supplied: DataFrame | str | None = None) -> DataFrame:
        """Deduplicate supplied terms (a table with source, target and ord, or a JSON file) and found ones; some document must be
        analysed first, those that aren't stay behind. The glossary is stored in the order of its folded sources, and as a CSV file."""
        if not jobs.gates(jobs.progress(self.read("units"), self._events())).where("can_lock").limit(1).count():
            raise ValueError("every translatable unit of a document must be analysed before the glossary is locked")
        terms = self.read("terms", "ord bigint, pos int, source string, target string, direction string, domain string, confidence string, context_unit_ids array<string>, definition string, notes string, src_rank int")
        place = F.struct(F.col("ord").cast("long").alias("ord"), F.col("pos").cast("int").alias("pos")).alias("ord")
        terms = terms.select(*glossary.COLUMNS, "src_rank", place)
        if supplied is not None:
            given = glossary.read_terms(self.spark, supplied) if isinstance(supplied, str) else supplied
            lack = {c: F.lit(None).cast("array<string>" if c == "context_unit_ids" else "string") for c in glossary.COLUMNS if c not in given.columns}
            terms = given.withColumns({**lack, "pos": F.lit(0), "src_rank": F.lit(0)}).select(*glossary.COLUMNS, "src_rank", place).unionByName(terms)
        glossary.in_order(glossary.deduped(terms)).write.mode("overwrite").parquet(self._path("glossary"))
        locked = self.read("glossary")
        glossary.write_csv(locked, self._path("glossary.csv"))
        return locked.orderBy("ord")

    def targets(self) -> DataFrame:
        kind = dict(self.read("units").dtypes)["doc_id"]
        pair = f"doc_id {kind}, id string, target string, at timestamp"
        return responses.effective_targets(responses.latest(self.read("translations", pair)), responses.latest(self.read("corrections", pair)))

    def finalize(self) -> DataFrame:
        """Render both outputs as rows, and packages where files were read; returns the checks of each document.

        Documents that lack translations are left out and listed in ``unfinished`` with the number that they lack; where all
        do, it is an error. Packages are read again and checked; the result is stored as ``qa`` (and as JSON lines), with ``report`` and ``artefacts``.
        """
        units = roles.completed(self.read("units"))
        self.targets().write.mode("overwrite").parquet(self._path("targets"))
        targets = self.read("targets")
        lacking = units.where("translatable").join(targets, ["doc_id", "id"], "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("lacking"))
        lacking = self._kept("unfinished", lacking)
        units = units.join(lacking, "doc_id", "left_anti")
        if lacking.limit(1).count() and not units.limit(1).count():
            raise ValueError("no document has translations of all its translatable units")
        rendering.bilingual_cells(units, targets).write.mode("overwrite").parquet(self._path("bilingual"))
        rendering.english_copy(units, targets).write.mode("overwrite").parquet(self._path("english"))
        if not units.where("part <> 'text'").limit(1).count():
            return self._kept("qa", checks.cells(units, targets, self.read("bilingual")))
        files = self.read("files").where("error IS NULL").join(lacking, "doc_id", "left_anti")
        placed = units.join(targets, ["doc_id", "id"]).select("doc_id", "part", "place", "text", "target", "bilingual_output", "english_output")
        two = self._kept("bilingual_files", render_ooxml.rendered(files, placed.where("bilingual_output"), True))
        copies = files.join(units.where("document_direction = 'zh-to-en'").select("doc_id").distinct(), "doc_id", "left_semi")
        one = self._kept("english_files", render_ooxml.rendered(copies, placed.where("english_output"), False))
        qa = self._kept("qa", package_checks.packages(units, targets, files, two, one))
        qa.write.mode("overwrite").json(self._path("qa.json"))
        self._kept("report", package_checks.report(qa, files))
        own = qa.join(files.select("doc_id", "path"), "doc_id")
        self._kept("artefacts", own.select("doc_id", *(c.alias(n) for n, c in jobs.artefacts(F.col("path"), self._path("output"), F.col("english_required")).items())))
        return qa

    def deliver(self, root: str, flat: bool = False) -> DataFrame:
        """Write the output files of finalized packages under ``root``, a folder for each or all in one; returns (path, bytes).
        They are put in place when all are written, and ``root`` then has a list of them.

        Inputs whose outputs would have the same name are refused before anything is written.
        """
        qa = self.read("qa")
        own = qa.join(self.read("files").select("doc_id", "path"), "doc_id")
        names = jobs.artefacts(F.col("path"), "", F.col("english_required"), flat)
        named = own.select("doc_id", *(c.alias(n) for n, c in names.items()), F.to_json(F.struct(*qa.columns), {"ignoreNullFields": "false"}).alias("_qa"))
        twice = named.groupBy("qa").count().where("count > 1").select("qa").first()
        if twice:
            raise ValueError(f"several inputs would be written to {root}{twice[0]}")
        text = lambda name, value: F.struct(F.col(name).alias("path"), F.encode(value, "UTF-8").alias("content"))
        told = named.join(self.read("report").withColumnRenamed("report", "_report"), "doc_id")
        terms = F.lit(glossary.csv_text(self.read("glossary")))
        rows = told.select(F.inline(F.array(text("qa", F.col("_qa")), text("report", F.col("_report")), text("glossary", terms))))
        for name in ("bilingual", "english"):
            rows = rows.union(named.where(F.col(name).isNotNull()).join(self.read(f"{name}_files"), "doc_id").select(F.col(name).alias("path"), "content"))
        return self._kept("delivered", deliver(rows, root))

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(name))
        return self.read(name)

    def export_units(self, path: str) -> None:
        """Units as JSON lines, a document's in order."""
        units = self.read("units")
        units.repartition("doc_id").sortWithinPartitions("doc_id", "unit_ord").write.mode("overwrite").json(path)

    def validate(self) -> DataFrame:
        return jobs.completeness(self.read("units"), self._events())

    def progress(self) -> DataFrame:
        return jobs.progress(self.read("units"), self._events())

    def run(self, model: provider.Provider, limit: int = batching.LIMIT, chars: int = batching.CHARS, supplied: DataFrame | str | None = None) -> DataFrame:
        """All phases until no batch is open, then the outputs; finished phases are skipped, so it can be started again.

        A pass asks all open batches of a phase; batches that were rejected are packed again for the next. Where a pass gets
        no answer accepted, the documents that are stuck stay behind, with their last problems in ``stuck``, and the others go on.
        """
        for phase in PHASES:
            if phase == "translation":
                self.lock_glossary(supplied)
            while True:
                path = self._path(f"answers/{phase}-{uuid.uuid4().hex}")
                self.open_batches(phase, limit, chars).write.parquet(path + "/payloads")
                payloads = self.spark.read.parquet(path + "/payloads")
                if not payloads.limit(1).count():
                    break
                provider.answers(payloads, model).write.parquet(path + "/answers")
                answers = self.spark.read.parquet(path + "/answers")
                got = answers.where("answer IS NOT NULL").select("doc_id", "batch_no", F.col("answer").alias("content"))
                verdicts = self.ingest(phase, payloads, got)
                if not verdicts.where("accepted").limit(1).count():
                    stuck = answers.groupBy("doc_id").agg(F.lit(phase).alias("phase"), F.count(F.lit(1)).alias("batches"), F.max("problem").alias("problem"))
                    stuck.write.mode("overwrite").parquet(self._path(f"stuck/pass={phase}"))
                    break
        return self.finalize()
