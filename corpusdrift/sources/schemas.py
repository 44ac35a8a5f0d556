"""Explicit schemas of the stage tables; reading never infers types."""

PARSED_PART = "title_id string, part_id string, part_heading string, part_authority string"
PARSED_SECTION = (
    "title_id string, section_name string, section_text string, section_type string, "
    "part_id string, section_id string"
)
NOTABLE_SECTIONS = (
    "title_id string, part_id string, section_id string, section_name string, "
    "section_text string, section_deviance double, notable_deviant string, year_id string"
)
PART_FOCAL = (
    "year_id string, title_id string, part_id string, part_heading string, "
    "part_authority string, deviance_mean double"
)
PART_TEMPORAL = (
    "year_id string, title_id string, part_id string, section_count bigint, "
    "authority_count bigint, part_word_count bigint, focal_year_match double"
)
TITLES = "title_id string, title_name string, title_num int, title_name_full string"
