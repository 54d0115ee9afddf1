"""Declared schemas, as DDL strings."""


# Tables of the analytics mart as they lie on disk.
MART_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

READER_EVENT = (
    "id bigint, event_type string, session_id string, user_id string, device_os string, app_version string, "
    "country_code string, article_id string, article_title string, category string, duration_ms bigint, "
    "metadata string, created_at timestamp_ntz"
)

SESSION = (
    "session_id string, user_id string, device_os string, app_version string, country string, "
    "country_code string, is_new_install boolean, last_ping timestamp_ntz, created_at timestamp_ntz"
)

ARTICLE = (
    "id string, url string, title string, summary string, content string, language string, category string, "
    "source_name string, source_url string, source_score decimal(3,2), image_url string, author string, "
    "keywords array<string>, published_at timestamp_ntz, status string, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, latitude double, longitude double, cluster_id bigint"
)

# One posted batch of client events; either `events` or the single-event fields are set.
EVENT_POST = (
    "sessionId string, session_id string, userId string, deviceOs string, os string, appVersion string, "
    "countryCode string, type string, event string, ts bigint, articleId string, article_id string, "
    "articleTitle string, article_title string, category string, durationMs bigint, duration_ms bigint, "
    "metadata string, "
    "events array<struct<type: string, event: string, ts: bigint, articleId: string, article_id: string, "
    "articleTitle: string, article_title: string, category: string, durationMs: bigint, duration_ms: bigint, "
    "metadata: string>>"
)

HEARTBEAT = (
    "sessionId string, deviceId string, userId string, deviceOs string, os string, appVersion string, "
    "countryCode string, isNewInstall int, ping_at timestamp_ntz, ping_id bigint"
)

SOURCE_CATALOGUE = (
    "countries array<struct<country: string, country_code: string, "
    "sources: array<struct<name: string, url: string, category: string, type: string, "
    "language: array<string>, rank: int>>>>"
)
