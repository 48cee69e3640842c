"""Media-shaped inputs derived from the given tables.

Every view covers its whole table. The SQL gives the same rows in Spark and in
DuckDB, so the oracle starts from the same inputs.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelshelf import schemas
from reelshelf.plans.catalog import Inputs
from reelshelf.sources.tables import conform

AS_OF_YEAR = 2026
SCAN_TS = "2026-01-01T00:00:00"
LATER_TS = "2026-02-02T00:00:00"

MEDIA_FILES = """
SELECT o_orderkey AS file_id,
  'F:/MEDIA/' || root || '/b' || o_orderkey || '/' ||
  CASE WHEN o_orderkey % 5 = 0 THEN 'Set (1985)' WHEN o_orderkey % 17 = 0 THEN 'Christmas' ELSE 'Misc' END || '/' ||
  CASE CAST(o_orderkey % 10 AS INT)
    WHEN 0 THEN 'Title ' || k || ' (' || y || ').mkv'
    WHEN 1 THEN 'Title.' || k || '.' || y || '.1080p.BluRay.x264.mkv'
    WHEN 2 THEN 'Title.' || k || '.S' || (o_orderkey % 9) || 'E' || (o_orderkey % 23) || '.HDTV.mkv'
    WHEN 3 THEN 'Title ' || k || ' - 1x07 WEB-DL [grp].mp4'
    WHEN 4 THEN 'IMG_' || o_orderkey || '.JPG'
    WHEN 5 THEN 'Artist - Song ' || k || '.flac'
    WHEN 6 THEN 'Wednesday.2160p.UHD.REMUX.DTS-HD.mkv'
    WHEN 7 THEN 'Title ' || k || ' 1920x1080 pl lektor.mp4'
    WHEN 8 THEN 'Title_' || k || '_' || y || '_HDR.ts'
    ELSE 'notes ' || k || '.txt' END AS file_path,
  root AS source_root,
  CAST(floor(o_totalprice * 100) AS BIGINT) * 1000 AS size_bytes,
  o_orderdate AS mtime
FROM (SELECT *, CAST(o_custkey AS VARCHAR(20)) AS k, CAST(year(o_orderdate) AS VARCHAR(4)) AS y,
  CASE CAST(o_custkey % 19 AS INT) WHEN 0 THEN 'Christmas' WHEN 1 THEN 'Concert' WHEN 2 THEN 'Docu' WHEN 3 THEN 'Fun'
    WHEN 4 THEN 'Kids Movies' WHEN 5 THEN 'Kids Series' WHEN 6 THEN 'Movies' WHEN 7 THEN 'Movies Extras' WHEN 8 THEN 'Movies PL'
    WHEN 9 THEN 'Music' WHEN 10 THEN 'Music Clips' WHEN 11 THEN 'Others' WHEN 12 THEN 'Photography' WHEN 13 THEN 'Religious'
    WHEN 14 THEN 'Series' WHEN 15 THEN 'Series Original' WHEN 16 THEN 'Series Polish' WHEN 17 THEN 'Theater' ELSE 'Unlisted' END AS root
  FROM orders) o
"""

# The order of an order's lines as one number: line number, then part and supplier.
# No window, so an order with very many lines never gathers in one task. The top
# bits are the fold's chunk: 512 lines, as a line number occurs once in an order.
CHUNK_SHIFT = 49
MEDIA_TRACKS = """
SELECT l_orderkey AS file_id,
  CAST(l_linenumber AS BIGINT) * 1099511627776 + l_partkey * 1024 + l_suppkey % 1024 AS track_order,
  CASE l_linenumber WHEN 1 THEN 'Video' WHEN 2 THEN 'Audio' WHEN 3 THEN 'Audio' WHEN 4 THEN 'Audio' WHEN 5 THEN 'Text' WHEN 6 THEN 'Text' ELSE 'Menu' END AS track_type,
  CASE CAST(l_partkey % 7 AS INT) WHEN 0 THEN 'FLAC' WHEN 1 THEN 'TrueHD' WHEN 2 THEN 'E-AC-3' WHEN 3 THEN 'AAC' WHEN 4 THEN 'HEVC' WHEN 5 THEN 'AVC' END AS format,
  CASE CAST(l_partkey % 11 AS INT) WHEN 0 THEN 'Dolby TrueHD with Dolby Atmos' WHEN 1 THEN 'DTS:X' WHEN 2 THEN 'DTS-HD Master Audio' WHEN 3 THEN '' END AS commercial_name,
  CASE CAST(l_suppkey % 10 AS INT) WHEN 0 THEN 'pl' WHEN 1 THEN 'en' WHEN 2 THEN 'Polish' WHEN 3 THEN 'eng' WHEN 4 THEN 'cs' WHEN 5 THEN 'de' WHEN 6 THEN 'fra' WHEN 7 THEN 'Bengali' WHEN 8 THEN 'Italian' END AS language,
  CASE WHEN l_partkey % 3 = 0 THEN 'Track ' || CAST(l_partkey AS VARCHAR(20)) END AS title,
  CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN '2' WHEN 1 THEN '6' WHEN 2 THEN '8' END AS channels,
  CASE CAST(l_partkey % 6 AS INT) WHEN 1 THEN '5.1' WHEN 2 THEN '' END AS channel_s,
  CASE WHEN l_partkey % 13 = 0 THEN 'n/a' WHEN l_partkey % 29 = 0 THEN '0' ELSE CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) * 10 + 5 AS VARCHAR(20)) END AS bit_rate,
  CASE WHEN l_partkey % 7 = 3 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) * 1000 AS VARCHAR(20)) WHEN l_partkey % 7 = 4 THEN '0' END AS bit_rate_maximum,
  CASE WHEN l_partkey % 9 = 2 THEN CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR(20)) || '.5' END AS source_duration,
  CASE WHEN l_partkey % 211 = 17 THEN '99999999999' ELSE CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN '3840' WHEN 1 THEN '1920' WHEN 2 THEN '1280' WHEN 3 THEN '8.0' END END AS width,
  CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN '2160' WHEN 1 THEN '1080' WHEN 2 THEN '720' WHEN 3 THEN '480' END AS height,
  CASE WHEN l_partkey % 422 = 17 THEN '-2147483649' WHEN l_partkey % 2 = 0 THEN '10' ELSE '8' END AS bit_depth,
  CASE CAST(l_partkey % 4 AS INT) WHEN 0 THEN '23.976' WHEN 1 THEN '25.000' WHEN 2 THEN 'variable' END AS frame_rate,
  'Main@L' || CAST(l_suppkey % 5 AS VARCHAR(5)) AS format_profile,
  CASE WHEN l_suppkey % 3 = 0 THEN 'x265 ' || CAST(l_suppkey % 7 AS VARCHAR(5)) END AS writing_library,
  CASE WHEN l_linenumber = 1 AND l_partkey % 5 = 1 THEN repeat('opt=' || CAST(l_partkey AS VARCHAR(20)) || ' / ', 60) END AS encoding_settings,
  CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN '1.778' WHEN 1 THEN '' END AS display_aspect_ratio,
  '00:00:0' || CAST(l_linenumber AS VARCHAR(5)) || ':00' AS time_code_of_first_frame,
  CASE CAST(l_suppkey % 3 AS INT) WHEN 0 THEN 'Progressive' WHEN 1 THEN 'Interlaced' END AS scan_type,
  CASE WHEN l_partkey % 4 <> 1 THEN 'YUV' END AS color_space,
  CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'Dolby Vision' WHEN 1 THEN 'HDR10' WHEN 2 THEN '' END AS hdr_format,
  CASE WHEN l_partkey % 9 < 2 THEN 'BT.2020' END AS color_primaries,
  CASE WHEN l_partkey % 9 < 2 THEN 'PQ' END AS transfer_characteristics,
  CASE WHEN l_partkey % 9 < 3 THEN 'BT.2020 non-constant' END AS matrix_coefficients,
  CASE WHEN l_partkey % 18 < 2 THEN 'Display P3' END AS mastering_display_color_primaries,
  CASE WHEN l_partkey % 18 < 2 THEN 'min: 0.0050 cd/m2, max: ' || CAST(l_partkey % 1000 AS VARCHAR(5)) || ' cd/m2' END AS mastering_display_luminance,
  CASE WHEN l_partkey % 8 = 0 THEN '1000 cd/m2' WHEN l_partkey % 8 = 1 THEN 'unknown' END AS maximum_content_light_level,
  CASE WHEN l_partkey % 8 = 0 THEN CAST(l_partkey % 400 AS VARCHAR(5)) || ' cd/m2' END AS maximum_frameaverage_light_level,
  CASE WHEN l_partkey % 10 = 3 THEN 'Commentary' END AS service_kind,
  CASE CAST(l_suppkey % 4 AS INT) WHEN 0 THEN '-' || CAST(l_linenumber AS VARCHAR(5)) || '.5 ms' WHEN 1 THEN '0 ms' WHEN 2 THEN '12' END AS delay_relative_to_video,
  CASE WHEN l_partkey % 6 = 0 THEN 'Lossless' ELSE 'Lossy' END AS compression_mode,
  CASE l_returnflag WHEN 'R' THEN 'Yes' ELSE 'No' END AS forced,
  CASE WHEN l_partkey % 4 = 3 THEN 'zlib' END AS muxing_mode,
  CAST(CAST(floor(l_quantity) AS BIGINT) AS VARCHAR(20)) AS count_of_elements,
  CASE WHEN l_linenumber >= 7 AND l_partkey % 3 <> 0 THEN '00:00:01=Intro|00:20:00=Part ' || CAST(l_partkey AS VARCHAR(20)) || CASE WHEN l_partkey % 3 = 1 THEN '|01:05:00=Late' ELSE '' END END AS chapters
FROM lineitem
"""

MEDIA_GENERAL = """
SELECT l_orderkey AS file_id, CAST(0 AS BIGINT) AS track_order, 'General' AS track_type,
  CASE WHEN l_orderkey % 4 = 0 THEN 'MPEG-4' ELSE 'Matroska' END AS format,
  CASE WHEN l_orderkey % 4 <> 0 THEN 'Version 4' END AS format_version,
  CASE WHEN l_orderkey % 3 = 0 THEN 'mkvmerge v' || CAST(l_orderkey % 90 AS VARCHAR(5)) END AS writing_application,
  CASE WHEN l_orderkey % 3 = 1 THEN 'UTC 2020-01-0' || CAST(1 + l_orderkey % 9 AS VARCHAR(5)) END AS encoded_date,
  CASE WHEN l_orderkey % 5 = 2 THEN 'Movie ' || CAST(l_orderkey AS VARCHAR(20)) END AS movie_name,
  CASE WHEN l_orderkey % 6 = 1 THEN 'Box ' || CAST(l_orderkey % 40 AS VARCHAR(5)) END AS collection,
  CASE WHEN l_orderkey % 10 = 5 THEN 'Song ' || CAST(l_orderkey AS VARCHAR(20)) END AS track_name,
  CASE WHEN l_orderkey % 10 = 5 THEN 'Artist ' || CAST(l_orderkey % 50 AS VARCHAR(5)) END AS performer,
  CASE WHEN l_orderkey % 9 = 4 THEN 'About ' || CAST(l_orderkey AS VARCHAR(20)) END AS description,
  CASE WHEN l_orderkey % 10 = 5 THEN CAST(1970 + l_orderkey % 50 AS VARCHAR(5)) END AS recorded_date,
  CASE CAST(l_orderkey % 7 AS INT) WHEN 0 THEN '2' WHEN 1 THEN '3.0' WHEN 2 THEN ' 4 ' END AS part_id,
  CASE WHEN l_orderkey % 12 = 0 THEN 'upscaled' WHEN l_orderkey % 12 = 1 THEN repeat('model ' || CAST(l_orderkey AS VARCHAR(20)) || ' ', 50) END AS videoai,
  CASE WHEN l_orderkey % 20 = 0 THEN 'CRC' END AS errordetectiontype,
  CASE WHEN l_orderkey % 8 = 0 THEN 'cover.jpg' END AS attachments,
  CASE WHEN l_orderkey % 4 <> 0 THEN CAST(l_orderkey * 7919 AS VARCHAR(20)) END AS unique_id,
  CASE WHEN l_orderkey % 31 = 0 THEN '0' ELSE CAST(CAST(sum(floor(l_extendedprice)) AS BIGINT) * 100 + 5 AS VARCHAR(20)) END AS duration,
  CAST(CAST(sum(floor(l_extendedprice)) AS BIGINT) * 150 + 5 AS VARCHAR(20)) AS overall_bit_rate
FROM lineitem GROUP BY l_orderkey
"""

# One search reply per customer, endpoint and query; three hits of different years.
SEARCH_REPLIES = """
SELECT e AS endpoint,
  CASE WHEN c_custkey % 19 = 8 OR c_custkey % 19 = 16 THEN 'pl-PL' ELSE 'en-US' END AS language,
  CASE WHEN c_custkey % 11 = 0 THEN 'Other ' ELSE 'Title ' END || CAST(c_custkey AS VARCHAR(20)) AS query,
  transform(array(1, 2, 3), r -> named_struct(
    'id', c_custkey * 10 + r + CASE WHEN e = 'tv' THEN 3 ELSE 0 END,
    'year', 1993 + CAST((c_custkey + r * 3) % 9 AS INT))) AS results
FROM (SELECT c_custkey, explode(array('movie', 'tv')) AS e FROM customer) c
"""
# The same candidates for the oracle, already exploded.
REF_SEARCH_ORACLE = """
SELECT e AS endpoint,
  CASE WHEN c_custkey % 19 = 8 OR c_custkey % 19 = 16 THEN 'pl-PL' ELSE 'en-US' END AS language,
  CASE WHEN c_custkey % 11 = 0 THEN 'Other ' ELSE 'Title ' END || CAST(c_custkey AS VARCHAR(20)) AS query,
  1993 + CAST((c_custkey + r * 3) % 9 AS INT) AS year,
  r AS rank, c_custkey * 10 + r + CASE WHEN e = 'tv' THEN 3 ELSE 0 END AS id
FROM customer CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) v
  CROSS JOIN (SELECT 'movie' AS e UNION ALL SELECT 'tv') w
"""

REF_DETAILS = """
SELECT endpoint, CASE WHEN id % 7 = 4 THEN 'xx-XX' ELSE language END AS language, id,
  '{' || CASE WHEN endpoint = 'movie' THEN '"title":"' ELSE '"title":"","name":"' END || query || '","original_title":"O ' || query ||
  '","vote_average":' || CAST(id % 10 AS VARCHAR(5)) || '.5,"vote_count":' || CAST(id AS VARCHAR(20)) ||
  ',"genres":' || CASE WHEN id % 5 = 0 THEN '[]' ELSE '[{"name":"Drama"},{"name":"G' || CAST(id % 6 AS VARCHAR(5)) || '"}]' END ||
  ',"' || CASE WHEN endpoint = 'movie' THEN 'release_date' ELSE 'first_air_date' END || '":"' || CAST(year AS VARCHAR(5)) || '-01-02"' ||
  CASE WHEN id % 3 = 0 THEN ',"overview":"About ' || query || '","poster_path":"/p' || CAST(id AS VARCHAR(20)) || '.jpg"' ELSE '' END ||
  CASE WHEN endpoint = 'movie' THEN ',"runtime":' || CAST(60 + id % 90 AS VARCHAR(5)) ELSE ',"episode_run_time":' || CASE WHEN id % 4 = 0 THEN '[]' ELSE '[45,50]' END END ||
  ',"production_countries":[{"iso_3166_1":"PL"},{"iso_3166_1":"US"}]}' AS json
FROM ref_search
"""
# Some replies cut off in the middle, some with a field of an odd type.
BROKEN_DETAILS = """
SELECT endpoint, language, id, CASE WHEN id % 13 = 5 THEN substr(json, 1, 40)
  WHEN id % 17 = 3 THEN replace(json, '"runtime":', '"runtime":45.5,"minutes":')
  WHEN id % 17 = 4 THEN replace(json, '"vote_count":', '"vote_count":3000000000,"votes":')
  WHEN id % 17 = 5 THEN replace(json, '"genres":', '"genres":"Drama","tags":')
  WHEN id % 17 = 6 THEN replace(json, '"vote_average":', '"vote_average":"7.5 of 10","average":')
  WHEN id % 17 = 7 THEN replace(json, '"title":"', '"title":45,"heading":"')
  WHEN id % 17 = 8 THEN replace(json, '"runtime":', '"runtime":"88","minutes":')
  WHEN id % 17 = 9 THEN replace(json, '"episode_run_time":', '"episode_run_time":50,"run_times":')
  ELSE json END AS json FROM ref_details
"""

IMAGES = """
SELECT file_id, CAST(1000 + file_id % 5000 AS INT) AS width, CAST(800 + file_id % 3000 AS INT) AS height,
  CASE WHEN file_id % 7 <> 0 THEN ' Maker ' || CAST(file_id % 3 AS VARCHAR(5)) || ' ' END AS make,
  CASE WHEN file_id % 7 <> 0 THEN 'M' || CAST(file_id % 20 AS VARCHAR(5)) || '  ' END AS model,
  CASE WHEN file_id % 3 = 0 THEN '2020:01:02 03:04:05' END AS taken
FROM media_files WHERE file_path LIKE '%.JPG'
"""

STATE = """
SELECT CASE WHEN file_id % 11 = 0 OR file_id % 3 = 0 THEN 'gone/' || file_path ELSE file_path END AS file_path, mtime,
  CASE WHEN file_id % 7 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes,
  CAST(file_id % 2 AS INT) AS tmdb_enriched
FROM media_files
"""

# A raw listing as text: some sizes are no numbers, some rows have no time.
RAW_LISTING = """
SELECT file_id, file_path, source_root,
  CASE WHEN file_id % 37 = 0 THEN 'n/a' WHEN file_id % 41 = 0 THEN '-1' ELSE CAST(size_bytes AS VARCHAR(20)) END AS size_text,
  CASE WHEN file_id % 43 = 0 THEN NULL ELSE mtime END AS mtime
FROM media_files
"""


class Views:
    """The derived inputs of one data folder, as DataFrames. All lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        """A given table."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        text = text.replace("{", "{{").replace("}", "}}")
        for name in frames:
            text = _braced(text, name)
        return self.spark.sql(text, **frames)

    @property
    def files(self) -> DataFrame:
        return self._sql(MEDIA_FILES, orders=self.table("orders"))

    @property
    def tracks(self) -> DataFrame:
        lines = self._sql(MEDIA_TRACKS, lineitem=self.table("lineitem")).withColumn(
            "extra", F.str_to_map("chapters", F.lit(r"\|"), F.lit("="))
        )
        general = self._sql(MEDIA_GENERAL, lineitem=self.table("lineitem"))
        schema = schemas.T.StructType(
            [schemas.T.StructField("file_id", schemas.T.LongType())] + schemas.TRACKS.fields[1:]
        )
        return conform(lines, schema).unionAll(conform(general, schema))

    @property
    def chunk(self):
        return F.shiftright("track_order", CHUNK_SHIFT)

    @property
    def search_replies(self) -> DataFrame:
        # A small file is one task, and each of its rows becomes six candidates and their details: dealt while narrow.
        customers = self.table("customer").select("c_custkey")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self._sql(SEARCH_REPLIES, customer=customers.repartition(tasks, "c_custkey"))

    @property
    def search(self) -> DataFrame:
        from reelshelf.operators.enrichment import explode_search

        return explode_search(self.search_replies)

    @property
    def details(self) -> DataFrame:
        return self._sql(REF_DETAILS, ref_search=self.search)

    @property
    def broken_details(self) -> DataFrame:
        return self._sql(BROKEN_DETAILS, ref_details=self.details)

    @property
    def images(self) -> DataFrame:
        exif = F.map_filter(
            F.create_map(
                F.lit("Make"), F.col("make"), F.lit("Model"), F.col("model"),
                F.lit("DateTimeOriginal"), F.col("taken"),
            ),
            lambda k, v: v.isNotNull(),
        )
        return self._sql(IMAGES, media_files=self.files).select("file_id", "width", "height", exif.alias("exif"))

    @property
    def state(self) -> DataFrame:
        return self._sql(STATE, media_files=self.files)

    @property
    def raw_listing(self) -> DataFrame:
        listing = self._sql(RAW_LISTING, media_files=self.files)
        return listing.select(
            "file_id", "file_path", "source_root", F.col("size_text").try_cast("bigint").alias("size_bytes"), "mtime"
        )

    @property
    def inputs(self) -> Inputs:
        return Inputs(
            self.files, self.tracks, self.images, self.search, self.details, key="file_id", track_chunk=self.chunk
        )


def _braced(text: str, name: str) -> str:
    """'FROM name' -> 'FROM {name}', the way spark.sql takes a DataFrame argument."""
    return text.replace(f"FROM {name}", "FROM {" + name + "}")
