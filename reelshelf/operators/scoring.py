"""Quality score of a folded row, 0 to 100."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelshelf.functions import fixed_values as V


def quality_score() -> Column:
    """Sum of points over the columns of a folded row. The parts can't exceed 100."""
    c = F.col
    picture = (
        F.when(c("is_4k") == 1, V.SCORE_4K)
        .when(c("height") >= 1080, V.SCORE_1080)
        .when(c("height") >= 720, V.SCORE_720)
    )
    light = F.when(c("has_dolby_vision") == 1, V.SCORE_DOLBY_VISION).when(c("has_hdr") == 1, V.SCORE_HDR)
    sound = (
        F.when((c("has_atmos") == 1) | (c("has_dts_x") == 1), V.SCORE_OBJECT_AUDIO)
        .when(c("has_lossless_audio") == 1, V.SCORE_LOSSLESS)
        .when(c("audio_count") > 1, V.SCORE_MULTI_AUDIO)
    )
    rate = F.when(F.lit(False), 0)
    for above, points in V.SCORE_BITRATES:
        rate = rate.when(c("overall_bitrate_kbps") > above, points)
    polish = F.when(c("has_polish_subtitles") == 1, V.SCORE_POLISH_SUBTITLES)
    ai = F.when(c("has_ai_upscaling") == 1, V.SCORE_AI)
    total = F.lit(0)
    for part in (picture, light, sound, rate, polish, ai):
        total = total + F.coalesce(part, F.lit(0))
    return total.cast("double")
