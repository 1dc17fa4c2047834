"""The engine: tables of vacancies and candidates, ingestion, recommendations, evaluation."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Settings
from ..functions import text as X
from ..operators import keyphrases, ranking, scoring, scratch, store, tfidf
from ..sources import files
from ..streaming import ingest, progress
from . import parse as plans


class VacancyNotFound(LookupError):
    pass


class EmbeddingMissing(LookupError):
    pass


class Conflict(ValueError):
    pass


@dataclass(frozen=True)
class Evaluation:
    """per_query: metrics; averages: one row; examples: the first of each query's ranking, with what
    they are labelled as, whether that is right, and the explanation."""

    per_query: DataFrame
    averages: DataFrame
    examples: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder=keyphrases.hash_embedding, scorer=None, model=None, pdf_words=None, phrases: tuple = (), prompts: scoring.Prompts | None = None):
        self.spark, self.root, self.settings = spark, root.rstrip("/"), settings or Settings()
        self.embedder, self.model, self.pdf_words, self.phrases, self.prompts = embedder, model, pdf_words, phrases, prompts
        s = self.settings
        # a plain function from (system, prompt) to an answer gets the settings' limits
        self.scorer = scoring.Scorer(scorer, concurrent=s.scorer_concurrent, tasks=s.scorer_tasks, timeout_s=s.scorer_timeout_s, retries=s.scorer_retries) if callable(scorer) else scorer
        self.vacancies = store.Table(spark, f"{self.root}/vacancies", schemas.VACANCIES, buckets=s.buckets)
        self.candidates = store.Table(spark, f"{self.root}/candidates", schemas.CANDIDATES, buckets=s.buckets)
        self._query, self._fitted, self._log = None, {}, None

    def health(self) -> dict:
        return {"status": "ok"}

    def _embedding(self, c: Column) -> Column:
        return keyphrases.embed(c, self.settings.embedding_dim, self.embedder)

    def _vacancy_embedding(self) -> Column:
        return self._embedding(F.concat("title", F.lit("\n\n"), "description"))

    # --- vacancies ---------------------------------------------------------------------

    def list_vacancies(self) -> DataFrame:
        return self.vacancies.read().select("id", "title", "experience", "source_filename", F.col("embedding").isNotNull().alias("has_embedding"), "created_at").orderBy("id")

    def vacancy(self, id_: int) -> DataFrame:
        return files.by_id(self.vacancies.read(), id_)

    def create_vacancy(self, title: str, description: str, experience: str | None = None, source_filename: str | None = None) -> int:
        if not title or len(title) > 512 or not description:
            raise ValueError("a title of 1 to 512 characters and a description are needed")
        name, current = source_filename or f"ui_{uuid.uuid4().hex[:8]}.json", self.vacancies.read()
        if not current.where(F.col("source_filename") == name).isEmpty():
            raise Conflict(name)
        row = self.spark.createDataFrame([(title, experience, description, name)], "title string, experience string, description string, source_filename string")
        row = row.withColumn("embedding", self._vacancy_embedding()).withColumn("created_at", F.current_timestamp())
        row = store.with_ids(row, current, "source_filename")
        self.vacancies.append(row)
        return self.vacancies.read().where(F.col("source_filename") == name).first()["id"]

    def update_vacancy(self, id_: int, title: str | None = None, description: str | None = None, experience: str | None = None) -> None:
        current = self.vacancies.read()
        if files.by_id(current, id_).isEmpty():
            raise VacancyNotFound(id_)
        change = self.spark.createDataFrame([(id_, title, description, experience)], "id long, title string, description string, experience string")
        self.vacancies.change(change, lambda at: store.update_vacancies(at, change, self._vacancy_embedding()))

    def delete_vacancy(self, id_: int) -> None:
        row = files.by_id(self.vacancies.read(), id_)
        if row.isEmpty():
            raise VacancyNotFound(id_)
        self.vacancies.change(row, lambda at: at.where(F.col("id") != id_))

    def import_vacancies(self, path: str, force: bool = False) -> dict:
        """Adds the vacancies of a directory of JSON files; with ``force``, they replace those
        of their file name and lose their embeddings."""
        good, bad = files.vacancies_json(self.spark, path)
        current = self.vacancies.read()
        new = good if force else store.new_rows(good, current, "source_filename")
        rows = new.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("created_at", F.current_timestamp())
        n, total = new.count(), good.count() + bad.count()
        rows = store.with_ids(rows, current, "source_filename")
        if force:
            store.replace(self.vacancies, current, rows, "source_filename")
        else:
            self.vacancies.append(rows)
        return {"imported": n, "skipped": total - n}

    def embed_vacancies(self) -> None:
        self.vacancies.change(self.vacancies.read().where("embedding is null"), lambda at: store.backfill_embeddings(at, self._vacancy_embedding()))

    # --- candidates --------------------------------------------------------------------

    def list_candidates(self, include_eval: bool = False, limit: int = 200) -> DataFrame:
        if not 1 <= limit <= 2000:
            raise ValueError("limit must be between 1 and 2000")
        at = self.candidates.read()
        at = at if include_eval else ranking.production(at)
        return at.select("id", "name", "email", "source_file", "created_at").orderBy(F.desc("id")).limit(limit)

    def candidate(self, id_: int) -> DataFrame:
        return files.by_id(self.candidates.read(), id_).withColumn("raw_text", X.excerpt(F.col("raw_text"), self.settings.excerpt)).drop("embedding")

    def update_candidate(self, id_: int, name: str | None = None, email: str | None = None) -> None:
        current = self.candidates.read()
        if files.by_id(current, id_).isEmpty():
            raise LookupError(id_)
        change = self.spark.createDataFrame([(id_, name, email)], "id long, name string, email string")
        self.candidates.change(change, lambda at: store.update_candidates(at, change, "name", "email"))

    def upload(self, filename: str, content: bytes) -> int:
        """Parses and adds one file; its id. ValueError for a file that is refused or can't
        be read, Conflict for one whose content is known."""
        one = self.spark.createDataFrame([(filename, bytearray(content))], "filename string, content binary")
        good, bad = files.screen_uploads(one, self.settings.max_upload_bytes)
        refused = bad.first()
        if refused:
            raise ValueError(refused["reason"])
        at = good.select(X.sanitize_filename(F.col("filename")).alias("source_file"), "content", X.content_hash(F.col("content")).alias("content_hash"))
        digest = at.first()["content_hash"]
        current = self.candidates.read()
        if not current.where(F.col("content_hash") == digest).isEmpty():
            raise Conflict(digest)
        row = self.parse_files(at)
        failed = row.where("error is not null").first()
        if failed:
            raise ValueError(failed["error"])
        row = store.with_ids(row.drop("error"), current, "source_file")
        row = row.withColumn("source_file", X.final_name(F.col("id"), F.col("source_file")))
        self.candidates.append(row)
        return self.candidates.read().where(F.col("content_hash") == digest).first()["id"]

    def delete_candidate(self, id_: int, files_under: str | None = None) -> None:
        """Removes a candidate, and its file if that lies under the folder ``files_under``."""
        current = self.candidates.read()
        row = files.by_id(current, id_).first()
        if row is None:
            raise LookupError(id_)
        self.candidates.change(files.by_id(current, id_), lambda at: at.where(F.col("id") != id_))
        if files_under and row["source_file"].startswith(files_under.rstrip("/") + "/"):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row["source_file"])
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False)

    def backfill_hashes(self, folder: str) -> None:
        found = files.discover(self.spark, folder)
        self.candidates.change(self.candidates.read().where("content_hash is null"), lambda at: store.backfill_hashes(at, found))

    def by_email(self) -> DataFrame:
        """(email, n, ids): how many candidates have an address, and the settings' listed_ids first of
        them, none for those without an address."""
        at = self.candidates.read().select("email", "id")
        first = ranking.top_k(at.where("email is not null"), self.settings.listed_ids, F.col("id"), by="email")
        ids = first.groupBy("email").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        counts = at.groupBy("email").agg(F.count(F.lit(1)).alias("n"))
        return counts.join(ids, "email", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>"))).orderBy(F.asc_nulls_last("email"))

    def import_labelled(self, csv_path: str) -> None:
        """Labelled résumés under their evaluation names; those there already are skipped."""
        at = files.resume_csv(self.spark, csv_path).select(F.concat(F.lit(X.EVAL_PREFIX), "ID").alias("source_file"), F.col("Resume_str").alias("raw_text"), F.col("Category").alias("category"))
        current = self.candidates.read()
        new = store.new_rows(at, current, "source_file").withColumn("embedding", self._embedding(F.col("raw_text"))).withColumn("created_at", F.current_timestamp())
        empty = {f.name: F.lit(None).cast(f.dataType) for f in schemas.PARSED.fields}
        new = new.withColumn("parsed", F.struct(*[(F.col("category") if k == "category" else v).alias(k) for k, v in empty.items()])).drop("category")
        self.candidates.append(store.with_ids(new, current, "source_file"))

    # --- ingestion -----------------------------------------------------------------------

    def parse_files(self, found: DataFrame) -> DataFrame:
        """Candidate rows of (source_file, content, content_hash), with ``error`` where a file
        can't be read."""
        at = found.withColumn("doc_id", F.xxhash64("content_hash"))
        lines, failed = files.extract_lines(at.select("doc_id", F.col("source_file").alias("path"), "content"), self.pdf_words)
        got = plans.parse(lines, self.phrases, self.model).select("doc_id", "raw_text", "parsed", self._embedding(F.col("raw_text")).alias("embedding"))
        rows = at.drop("content").join(got, "doc_id", "left").join(failed.select("doc_id", "error"), "doc_id", "left").drop("doc_id")
        return rows.withColumn("name", F.col("parsed.name")).withColumn("email", F.col("parsed.email")).withColumn("created_at", F.current_timestamp())

    def parse_path(self, path: str, force: bool = False, dry_run: bool = False):
        """Parses the files under a path. Those in the table are skipped, or with ``force``
        parsed anew; a dry run returns the parsed rows and writes nothing."""
        at = files.discover(self.spark, path).select(F.col("path").alias("source_file"), "content", X.content_hash(F.col("content")).alias("content_hash"))
        if dry_run:
            return self.parse_files(at)
        if not force:  # files there already aren't parsed again
            at = at.join(self.candidates.read().select("source_file"), "source_file", "left_anti")
        return ingest.ingest_batch(at, self.candidates, self.parse_files, replace=force)

    def ingest_mail(self, messages: DataFrame, every: str | None = None) -> str:
        """Starts a run over a stream of messages (sources.mailbox): attachments become
        candidates under {id}_{name}, those whose content is known are left out. Returns its id."""
        at = ingest.attachments(messages).select(F.col("filename").alias("source_file"), "content", "content_hash")
        return self._started(at, "mail", every, named=True)

    def quarantine(self) -> DataFrame:
        """Files that could not be parsed, with the reason."""
        return ingest.quarantine(self.candidates)

    def ingest_once(self, landing: str) -> str:
        """Starts one run over what has arrived; returns its id."""
        return self._started(self._landed(landing), "landing")

    def ingest_polling(self, landing: str) -> str:
        """Starts a run that looks for new files every poll_seconds; returns its id."""
        return self._started(self._landed(landing), "landing", f"{self.settings.poll_seconds} seconds")

    def ingest_to_the_end(self, landing: str, poll: bool = False) -> None:
        """Runs ingest_once() or ingest_polling() until it ends, again after a failure, as often as the
        settings' ingest_retries; the last failure is raised."""

        def again():
            self.ingest_polling(landing) if poll else self.ingest_once(landing)
            return self._query

        ingest.run_with_retries(again, self.settings.ingest_retries, self.settings.ingest_wait_s)

    def _landed(self, landing: str) -> DataFrame:
        return ingest.landing(self.spark, landing).select(F.col("path").alias("source_file"), "content", X.content_hash(F.col("content")).alias("content_hash"))

    def _started(self, stream: DataFrame, kind: str, every: str | None = None, named: bool = False) -> str:
        if self._log is None:
            self._log = progress.ProgressLog(self.spark, f"{self.root}/progress", f"rankspark {self.root}")
            self.spark.streams.addListener(self._log)
        self._query = ingest.start(stream, self.candidates, f"{self.root}/checkpoints/{kind}", self.parse_files, every, named=named, name=self._log.name)
        return str(self._query.runId)

    def wait(self) -> None:
        """Until the run ends; its failure is raised."""
        self._query.awaitTermination()

    def status(self) -> dict:
        """Of this engine's run, or else of the last one that any engine has started under this root."""
        if self._query:
            return ingest.status(self._query)
        return progress.last_run(self.spark, f"{self.root}/progress") or {"active": False}

    def runs(self) -> DataFrame:
        """Starts, progress, ends and failures of all runs under this root."""
        return progress.history(self.spark, f"{self.root}/progress")

    # --- recommendations -----------------------------------------------------------------

    def _queries(self, job_id: int | None, text: str | None, title: str | None) -> DataFrame:
        if (job_id is None) == (text is None):
            raise ValueError("give exactly one of job_id and text")
        if job_id is not None:
            at = self.vacancy(job_id)
            if at.isEmpty():
                raise VacancyNotFound(job_id)
            return at.select(F.col("id").alias("query_id"), F.concat("title", F.lit("\n\n"), "description").alias("query_text"), "title", "description", "embedding")
        if not 1 <= len(text) <= 20_000 or title and len(title) > 512:
            raise ValueError("text of 1 to 20000 and title of at most 512 characters")
        at = self.spark.createDataFrame([(0, f"{title}\n\n{text}" if title else text, title, text)], "query_id long, query_text string, title string, description string")
        return at.withColumn("embedding", self._embedding(F.col("query_text")))

    def rank(self, queries: DataFrame, strategy: str, k: int, scope: str = "production", retriever: str = "rrf", boost: float | None = None) -> DataFrame:
        """(query_id, candidate_id, rank, score[, explanation]) for all queries at once. boost: None for
        the settings'."""
        s = self.settings
        every = self.candidates.read().withColumnRenamed("id", "candidate_id")
        if strategy == "semantic":
            if not queries.where("embedding is null").isEmpty():
                raise EmbeddingMissing("a query has no embedding")
            return ranking.semantic(queries, ranking.in_scope(every, scope).select("candidate_id", "embedding"), k)
        if strategy == "tfidf":
            return self._tfidf(queries, k, scope, s.boost if boost is None else boost)
        if strategy == "rrf":
            fan = max(s.overfetch * k, k)
            return ranking.fuse([self.rank(queries, r, fan, scope, boost=boost) for r in ("semantic", "tfidf")], k, s.rrf_k)
        if strategy == "llm":
            short = self.rank(queries, retriever, s.shortlist, scope, boost=boost)
            return ranking.rerank(short, queries, every.select("candidate_id", "raw_text", "name", "parsed"), k, self.scorer, self.prompts)
        raise ValueError(f"unknown strategy {strategy!r}")

    def _texts(self, version: int | None = None) -> DataFrame:
        return self.candidates.read(version).withColumnRenamed("id", "candidate_id").where("raw_text is not null and length(raw_text) > 0")

    def _fit(self, scope: str = "production") -> tuple[DataFrame, DataFrame, object]:
        """(vocabulary, candidates' vectors, category classifier or None), fitted anew only when
        a table has another version than at the last fit; written under the engine's root. The scope
        eval has a fit of its own, on the labelled texts alone."""
        s, now = self.settings, (self.candidates.version(), self.vacancies.version())
        scope = "eval" if scope == "eval" else "all"
        if scope in self._fitted and self._fitted[scope][0] == now:
            return self._fitted[scope][1]
        texts = self._texts(now[0])
        labelled = texts.where(F.col("parsed.category").isNotNull() & F.col("source_file").startswith(X.EVAL_PREFIX))
        if scope == "eval":
            texts = labelled
            corpus = labelled.select(F.col("raw_text").alias("text"))
        else:
            jobs = self.vacancies.read(now[1]).select(F.concat("title", F.lit("\n\n"), "description").alias("text"))
            # labelled texts stand twice in the corpus: as candidates, and as the labelled set
            corpus = jobs.unionByName(texts.select(F.col("raw_text").alias("text"))).unionByName(labelled.select(F.col("raw_text").alias("text")))
        base = f"{self.root}/fits/{uuid.uuid4().hex}"
        tfidf.vocabulary(corpus, "text", s.min_df, s.max_features).write.parquet(f"{base}/vocabulary")
        vocab = self.spark.read.parquet(f"{base}/vocabulary")
        tfidf.vectors(texts.withColumn("category", F.col("parsed.category")), "candidate_id", "raw_text", vocab, carry=("category",)).write.parquet(f"{base}/vectors")
        docs = self.spark.read.parquet(f"{base}/vectors")
        predict = tfidf.classifier(docs, vocab) if docs.select("category").dropna().distinct().limit(2).count() == 2 else None
        if predict:
            predict(docs).write.parquet(f"{base}/categories")
            docs = self.spark.read.parquet(f"{base}/categories")
        else:
            docs = docs.drop("category")
        self._fitted[scope] = now, (vocab, docs, predict)
        return self._fitted[scope][1]

    def _tfidf(self, queries: DataFrame, k: int, scope: str, boost: float) -> DataFrame:
        vocab, docs, predict = self._fit(scope)
        literal = F.col("source_file").startswith(X.EVAL_PREFIX)  # here the prefix is literal
        texts = self._texts(self._fitted["eval" if scope == "eval" else "all"][0][0]).where(literal if scope == "eval" else ~literal if scope == "production" else F.lit(True))
        docs = docs.join(texts.select(F.col("candidate_id").alias("id"), (~F.coalesce(F.array_contains("parsed.languages_detected", "ru"), F.lit(False))).alias("boosts")), "id")
        asked = tfidf.vectors(queries.withColumn("boosts", ~X.is_russian(F.col("query_text"))), "query_id", "query_text", vocab, carry=("boosts",))
        if predict:
            asked = predict(asked)
        return tfidf.best(asked, docs, k, boost)

    def recommend(self, job_id: int | None = None, text: str | None = None, title: str | None = None, strategy: str | None = None, top_k: int | None = None, retriever: str | None = None) -> DataFrame:
        strategy, k = strategy or self.settings.strategy, top_k or self.settings.top_k
        if not 1 <= k <= 50:
            raise ValueError("top_k must be between 1 and 50")
        if retriever is not None and (strategy != "llm" or retriever not in ("semantic", "tfidf", "rrf")):
            raise ValueError("a retriever goes with the llm strategy, and is semantic, tfidf or rrf")
        found = self.rank(self._queries(job_id, text, title), strategy, k, retriever=retriever or "rrf")
        found = found if "explanation" in found.columns else found.withColumn("explanation", F.lit(None).cast("string"))
        payload = self.candidates.read().select(F.col("id").alias("candidate_id"), "name", "email", "source_file", "parsed")
        return found.join(payload, "candidate_id", "left").withColumn("strategy", F.lit(strategy)).orderBy("query_id", "rank")

    def evaluate(self, strategy: str, k: int = 10, retriever: str = "semantic", subset: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(metrics of each query, macro averages) of evaluation()."""
        got = self.evaluation(strategy, k, retriever, subset)
        return got.per_query, got.averages

    def evaluation(self, strategy: str, k: int = 10, retriever: str = "semantic", subset: int | None = None, boost: float | None = None, examples: int = 5) -> Evaluation:
        """Vacancies whose file names are labels, against candidates of the same label. The ranking is
        written once, so that a scorer is asked once."""
        jobs = self.vacancies.read().select(F.col("id").alias("query_id"), X.source_to_category(F.col("source_filename")).alias("category"), F.concat("title", F.lit("\n\n"), "description").alias("query_text"), "title", "description", "embedding").orderBy("query_id")
        jobs = jobs.limit(subset) if subset else jobs
        labelled = ranking.in_scope(self.candidates.read(), "eval").select(F.col("id").alias("candidate_id"), F.upper("parsed.category").alias("category"))
        path = scratch.folder(self.spark, "evaluation")
        self.rank(jobs, strategy, k, "eval", retriever, boost).write.parquet(path)
        found = self.spark.read.parquet(path)
        per = ranking.metrics(jobs, found, jobs.select("query_id", "category").join(labelled, "category"))
        shown = found.where(F.col("rank") <= examples).join(jobs.select("query_id", "category", "title"), "query_id").join(labelled.withColumnRenamed("category", "found_category"), "candidate_id", "left")
        shown = shown if "explanation" in shown.columns else shown.withColumn("explanation", F.lit(None).cast("string"))
        shown = shown.select("query_id", "category", "title", "rank", "candidate_id", "found_category", F.coalesce(F.col("category") == F.col("found_category"), F.lit(False)).alias("hit"), "score", "explanation")
        return Evaluation(per, ranking.macro(per), shown.orderBy("query_id", "rank"))

    def compare_boost(self, k: int = 10, subset: int | None = None) -> DataFrame:
        """(metric, without, with_boost, delta, percent) of TF-IDF without and with the category boost,
        in the order of the metrics; percent is null where the metric is 0 without."""
        return compared(*(self.evaluation("tfidf", k, subset=subset, boost=b).averages for b in (0.0, None)))


def compared(without: DataFrame, with_boost: DataFrame) -> DataFrame:
    """Two rows of averages with the same columns, one metric a row."""
    rows = lambda df, name: df.select(F.posexplode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias(name)) for c in df.columns])).alias("at", "x")).select("at", "x.*")
    at = rows(without, "without").join(rows(with_boost, "with_boost").drop("at"), "metric").withColumn("delta", F.col("with_boost") - F.col("without"))
    return at.withColumn("percent", F.when(F.col("without") > 0, 100 * F.col("delta") / F.col("without"))).orderBy("at").drop("at")
