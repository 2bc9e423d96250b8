"""Fixed table schemas. Channel is data, so any channel count fits."""

BLOCKS = (
    "recording_id string, channel int, block_id bigint, start_idx bigint, "
    "samples array<double>, left_halo array<double>, right_halo array<double>"
)
#: All channels of a block in a row: their samples with the halos, of which `before` samples lie before the block's `size`.
WIDE_BLOCKS = (
    "recording_id string, block_id bigint, start_idx bigint, before int, size int, "
    "channels array<struct<channel: int, samples: array<double>>>"
)
COUNTS = (
    "datetime string, num_impulse bigint, num_impulseINtrain bigint, num_impulsetrain bigint, "
    "num_tonal bigint, num_tonalsegment bigint, num_noise bigint"
)
ENVIRONMENT = "date timestamp, temperature double, pressure double, humidity double"
MEDIA = (
    "path string, kind string, rate_text string, frames bigint, duration double, "
    "comment_format string, comment_stream string"
)
