"""The dataset catalog: descriptors, lookups, and the catalog as a DataFrame."""

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nabd.fixed_values import DEFAULT_DATASETS

SOURCES = ("huggingface", "url")
DOMAINS = ("social_media", "news", "reviews", "general")


@dataclass(frozen=True)
class Dataset:
    """Where a corpus is, and which of its columns hold the canonical fields."""

    id: str
    name: str = ""
    name_ar: str = ""
    source: str = "url"
    domain: str = "general"
    hub_id: str | None = None
    hub_config: str | None = None
    hub_split: str = "train"
    path: str | None = None
    file_format: str | None = None
    fields: dict = field(default_factory=lambda: {"text": "text"})
    has_timestamp: bool = False
    has_user_metadata: bool = False
    has_engagement: bool = False
    size_estimate_rows: int = 0
    language: str = "ar"
    license: str = "unknown"
    description_ar: str = ""
    homepage: str = ""

    def __post_init__(self):
        if self.source not in SOURCES:
            raise ValueError(f"unknown source: {self.source}")
        if self.domain not in DOMAINS:
            raise ValueError(f"unknown domain: {self.domain}")

    def at(self, path: str, file_format: str) -> "Dataset":
        """The same dataset, read from exported files at `path`."""
        return replace(self, path=path, file_format=file_format)


def _corpus(id, name, name_ar, domain, hub_id, text, label, rows, license, about, config=None):
    return Dataset(
        id=id,
        name=name,
        name_ar=name_ar,
        source="huggingface",
        domain=domain,
        hub_id=hub_id,
        hub_config=config,
        fields={"text": text, "label": label},
        size_estimate_rows=rows,
        license=license,
        description_ar=about,
        homepage=f"https://huggingface.co/datasets/{hub_id}",
    )


# --- Fixed values: the public corpora ---
CATALOG = (
    _corpus(
        "ajgt", "Arabic Jordanian General Tweets", "تغريدات عربية أردنية عامة", "social_media",
        "ajgt_twitter_ar", "text", "label", 1_800, "Custom (research)",
        "مجموعة تغريدات أردنية معلَّمة للمشاعر (إيجابي/سلبي). صغيرة الحجم لكنها لهجة قريبة.",
    ),
    _corpus(
        "arabic_sentiment_corpus", "Arabic Sentiment Twitter Corpus",
        "مجمع تغريدات المشاعر العربية", "social_media",
        "arbml/Arabic_Sentiment_Twitter_Corpus", "tweet", "label", 58_000, "MIT",
        "حوالي 58 ألف تغريدة عربية معلَّمة للمشاعر، مناسبة للتدريب والتقييم على نموذج المشاعر.",
    ),
    _corpus(
        "hard", "Hotel Arabic Reviews Dataset", "مجمع تقييمات الفنادق العربية", "reviews",
        "hard", "text", "label", 370_000, "Apache-2.0",
        "أكثر من 370 ألف تقييم فندق بالعربية مع نجوم. ممتاز لاختبار التحليل على بيانات حقيقية وفيرة.",
    ),
    _corpus(
        "labr", "Large-scale Arabic Book Reviews", "مجمع تقييمات الكتب العربية الكبير", "reviews",
        "labr", "review", "label", 63_000, "GPL-2.0",
        "63 ألف مراجعة كتاب باللغة العربية مع تقييمات. متنوع المحتوى ويغطي مواضيع كثيرة.",
        config="plain_text",
    ),
    _corpus(
        "metooma", "Metooma Arabic Tweets", "تغريدات Metooma العربية", "social_media",
        "metooma", "text", "label", 10_000, "Custom",
        "مجموعة تغريدات عربية متنوعة المواضيع. مفيدة لتجربة التحليل على نصوص تويتر فعلية.",
    ),
    _corpus(
        "oclar", "Opinion Corpus for Lebanese Arabic Reviews", "مجمع آراء التقييمات اللبنانية العربية",
        "reviews", "oclar", "pred_0", "pred_1", 3_900, "Apache-2.0",
        "مجمع تقييمات بالعامية اللبنانية. مفيد لاختبار النموذج على لهجة شامية مغايرة للفصحى.",
    ),
    _corpus(
        "brad", "Books Reviews in Arabic Dataset", "مجمع تقييمات الكتب العربية الموسّع", "reviews",
        "brad", "review", "rating", 510_000, "MIT",
        "مجمع كبير لتقييمات الكتب العربية (>500 ألف) مع تصنيفات نجمية. مناسب لإثبات قدرة Big Data.",
    ),
    _corpus(
        "sanad", "Single-Label Arabic News Articles", "مقالات إخبارية عربية مصنّفة", "news",
        "arbml/SANAD", "text", "label", 190_000, "MIT",
        "190 ألف مقال إخباري عربي من 7 فئات. يوفّر سياقاً إخبارياً للكلمات المفتاحية.",
    ),
)


def find(catalog: Sequence[Dataset], dataset_id: str) -> Dataset | None:
    return next((d for d in catalog if d.id == dataset_id), None)


def resolve(
    catalog: Sequence[Dataset],
    dataset_ids: Sequence[str] | None = None,
    default: Sequence[str] = DEFAULT_DATASETS,
) -> list[Dataset]:
    """Descriptors of the ids, in order; unknown ids are skipped, none at all is an error."""
    found = [find(catalog, i) for i in (dataset_ids or default)]
    known = [d for d in found if d is not None]
    if not known:
        raise ValueError("no valid datasets selected")
    return known


def catalog_frame(spark: SparkSession, catalog: Sequence[Dataset] = CATALOG) -> DataFrame:
    """The catalog with one row per dataset and what each dataset can support."""
    columns = (
        "id name name_ar source domain hub_id path file_format size_estimate_rows has_timestamp "
        "has_user_metadata has_engagement language license description_ar homepage"
    ).split()
    kinds = {"size_estimate_rows": "bigint"} | {
        c: "boolean" for c in ("has_timestamp", "has_user_metadata", "has_engagement")
    }
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns)
    rows = [tuple(getattr(d, c) for c in columns) for d in catalog]
    return with_capabilities(spark.createDataFrame(rows, schema))


def with_capabilities(catalog: DataFrame) -> DataFrame:
    return catalog.withColumns(
        {
            "supports_influencers": F.col("has_user_metadata"),
            "supports_network": F.col("has_user_metadata"),
            "supports_timeline": F.col("has_timestamp"),
        }
    )


def list_datasets(
    catalog: DataFrame,
    domain: str | None = None,
    source: str | None = None,
    only_with_timestamp=False,
    only_with_user_metadata=False,
) -> DataFrame:
    """Catalog rows that meet every given condition."""
    if domain:
        catalog = catalog.filter(F.col("domain") == domain)
    if source:
        catalog = catalog.filter(F.col("source") == source)
    if only_with_timestamp:
        catalog = catalog.filter("has_timestamp")
    if only_with_user_metadata:
        catalog = catalog.filter("has_user_metadata")
    return catalog


def known_ids(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested ids (column `id`) that the catalog has."""
    return requested.join(catalog.select("id"), "id", "left_semi")


def unknown_ids(requested: DataFrame, catalog: DataFrame) -> DataFrame:
    return requested.join(catalog.select("id"), "id", "left_anti")
