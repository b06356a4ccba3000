"""What readers are served: image files, article images, icon labels, and the pages that show an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

FILE = ("key", "mime", "width", "height")


def primary_files(renders: DataFrame, files: DataFrame) -> DataFrame:
    """Renders (id, source_id, language, created_at, ...) with the columns of their primary file."""
    own = files.where("is_primary").select(F.col("image_id").alias("id"), *FILE)
    return renders.join(own, "id")


def served_files(renders: DataFrame, files: DataFrame, language: str) -> DataFrame:
    """(source_id, localized, original): the newest render in the language and the newest original (no language), or null.

    Newest by (created_at, id); both are partial aggregations over one exchange.
    """
    rows = primary_files(renders, files).where((F.col("language") == language) | F.col("language").isNull())
    file, order = F.struct(*FILE), F.struct("created_at", "id")
    newest = lambda test: F.max_by(file, F.when(test, order))
    return rows.groupBy("source_id").agg(newest(F.col("language").isNotNull()).alias("localized"), newest(F.col("language").isNull()).alias("original"))


def chosen_file(localized: Column, original: Column, translated: Column | bool) -> Column:
    """Translated pages prefer the localized file; others always show the original."""
    wanted = F.lit(translated) if isinstance(translated, bool) else translated
    return F.when(wanted, F.coalesce(localized, original)).otherwise(original)


def article_images(images: DataFrame, sources: DataFrame, served: DataFrame, texts: DataFrame, translated: bool, base: str = "/img") -> DataFrame:
    """images (..., key, src) with the address, size and alternative texts that a reader gets.

    sources: (key, source_id, texts_ja); texts: (source_id, spans) of the language.
    An image without a served file keeps its address; spans fall back to the
    transcription, and empty ones are null.
    """
    file = chosen_file(F.col("localized"), F.col("original"), translated)
    spans = F.coalesce("spans", "texts_ja") if translated else F.col("texts_ja")
    rows = images.join(sources, "key", "left").join(served, "source_id", "left").join(texts, "source_id", "left").withColumn("_file", file)
    return rows.select(
        *images.columns,
        F.coalesce(F.concat(F.lit(base + "/"), F.col("_file.key")), F.col("src")).alias("served_src"),
        F.col("_file.width").alias("width"),
        F.col("_file.height").alias("height"),
        F.when(F.size(spans) > 0, spans).alias("text"),
    )


def labelled_icons(events: DataFrame, sources: DataFrame, texts: DataFrame, separator: str = "：") -> DataFrame:
    """events (..., key, title_ja, localized_title) with the icon's name after their title; without a name the title stays."""
    rows = events.join(sources, "key", "left").join(texts, "source_id", "left")
    name = F.trim(X.joined_spans(F.coalesce("spans", "texts_ja", F.array().cast("array<string>"))))
    base = F.coalesce("localized_title", "title_ja")
    label = F.when(name != "", F.concat(base, F.lit(separator), name)).otherwise(F.col("localized_title"))
    return rows.select(*[c for c in events.columns if c != "localized_title"], label.alias("localized_title"))


def pages_with_image(changed: DataFrame, article_images: DataFrame, banners: DataFrame, paths: dict[str, str], base: str) -> DataFrame:
    """Distinct (key, url) of the pages that show a changed image (key, language).

    Articles come from the reverse index; an image of a banner also changes both
    forms of the language's home page.
    """
    root = F.concat(F.lit(base.rstrip("/") + "/"), F.col("language"))
    path = X.mapped(F.col("item_type"), paths)
    articles = changed.join(article_images.withColumnRenamed("image_key", "key"), "key").select("key", F.concat_ws("/", root, path, F.col("item_id")).alias("url"))
    homes = changed.join(banners.select(F.col("image_key").alias("key")).distinct(), "key", "left_semi")
    homes = homes.select("key", F.explode(F.array(root, F.concat(root, F.lit("/")))).alias("url"))
    return articles.unionByName(homes).distinct()


def url_chunks(urls: DataFrame, group: str, size: int = 30) -> DataFrame:
    """(group, chunk, urls): at most `size` urls in a request, in order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(group).orderBy("url")) - 1
    rows = urls.withColumn("chunk", F.floor(place / size).cast("int"))
    return rows.groupBy(group, "chunk").agg(F.array_sort(F.collect_list("url")).alias("urls"))


def article_urls(articles: DataFrame, languages: DataFrame, paths: dict[str, str], base: str) -> DataFrame:
    """(item_type, item_id, url): each article's page in every language; languages are a short list."""
    rows = articles.crossJoin(F.broadcast(languages.select("code")))
    return rows.select("item_type", "item_id", F.concat_ws("/", F.lit(base.rstrip("/")), F.col("code"), X.mapped(F.col("item_type"), paths), F.col("item_id")).alias("url"))


def ingest_units(images: DataFrame) -> DataFrame:
    """(item_id, key, transcribe) once for each image key of an article: may any of its places be transcribed?

    images: (item_id, key, transcribable) with a row for each place; keyless ones go.
    """
    return images.where("key is not null").groupBy("item_id", "key").agg(F.max("transcribable").alias("transcribe"))


def body_context(images: DataFrame, sources: DataFrame, done: DataFrame) -> DataFrame:
    """images (..., key) with `text`: the transcription to send along, or null.

    Only texts with Japanese letters are sent, and only where the image is not
    translated yet; done: (source_id).
    """
    rows = images.join(sources, "key", "left").join(done.select("source_id").distinct().withColumn("_done", F.lit(True)), "source_id", "left")
    wanted = X.any_japanese(F.coalesce("texts_ja", F.array().cast("array<string>"))) & F.col("_done").isNull()
    return rows.select(*images.columns, F.when(wanted, F.col("texts_ja")).alias("text"))


def without_original(sources: DataFrame, renders: DataFrame) -> DataFrame:
    """Sources that have no original render (one without a language)."""
    return sources.join(renders.where("language is null").select("source_id"), "source_id", "left_anti")


def latest_models(renders: DataFrame, language: str) -> DataFrame:
    """(source_id, model, found) of the newest render in a language."""
    return renders.where(F.col("language") == language).groupBy("source_id").agg(F.max_by("model", F.struct("created_at", "id")).alias("model"), F.lit(True).alias("found"))


def render_outcomes(sources: DataFrame, latest: DataFrame, model: str, manual: str = "manual", force: bool = False) -> DataFrame:
    """sources with `outcome`: skipped where the newest render is by this model or manual (unless forced), else render."""
    same = F.coalesce(F.col("found"), F.lit(False)) & F.col("model").isin(model, manual) & F.lit(not force)
    return sources.join(latest, "source_id", "left").withColumn("outcome", F.when(same, "skipped").otherwise("render")).drop("model", "found")


def untranslated(items: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Items to translate: all if forced, else those not done."""
    return items if force else items.join(done.select(key), key, "left_anti")
