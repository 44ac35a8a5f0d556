"""The same queries as plain SQL for DuckDB, written the long way round.

Where the library weights sums or ranks a few candidates, the SQL joins and ranks
all rows.
"""

# Named building blocks, in order of need.  Scores are averaged as whole millionths:
# means of six-digit scores often lie halfway between two six-digit numbers.
BLOCKS = {
    "fx_div": """
select doc_id,
  'Title-' || lpad(cast(cast(substr(source,4) as int) % 3 + 1 as varchar),2,'0')
    || '-' || cast(2022 + doc_id % 3 as varchar) as title_id,
  case when doc_id % 101 = 7 then 'NOTE'
       when doc_id % 11 = 0 or doc_id % 19 = 0 then 'APPENDIX' else 'SECTION' end as div_type,
  case when doc_id % 11 = 0 then 'Appendix A to Part ' || cast(p as varchar)
       when doc_id % 19 = 0 then 'Appendixes B to C to Subpart A of Part ' || cast(p as varchar)
       when doc_id % 13 = 0 then cast(doc_id as varchar)
       when doc_id % 17 = 0 then cast(p as varchar) || '.' || cast(doc_id as varchar) || '(a)-1'
       else cast(p as varchar) || '.' || cast(doc_id * 37 as varchar) end as div_n,
  text as section_text, p
from (select *, cast(floor(doc_id / 3) as bigint) % 7 as p from documents) t""",
    "fx_part": """
select title_id, 'PART-' || lpad(cast(p as varchar),4,'0') as raw_part_id,
  'Part-' || lpad(cast(p as varchar),4,'0') as part_id,
  'PART ' || cast(p as varchar) || case when p = 3 then ' [RESERVED]' else ' - RULES' end
    as part_heading,
  case when p = 5 then null else chr(10) || ' Authority: 1 U.S.C. 1'
    || repeat(', 5 U.S.C. 2', cast(p as int)) || ', and sec. 6. ' || chr(10) end as part_authority
from (select distinct title_id, p from fx_div) t""",
    "titles": """
select distinct substr(title_id,1,8) as title_id,
  'Rules ' || cast(cast(substr(title_id,7,2) as int) as varchar) as title_name,
  cast(substr(title_id,7,2) as int) as title_num,
  'Title ' || cast(cast(substr(title_id,7,2) as int) as varchar) || ' - Rules '
    || cast(cast(substr(title_id,7,2) as int) as varchar) as title_name_full
from fx_div""",
    "sec": """
select doc_id, title_id, section_text, section_type, section_name,
  'Part-' || lpad(case when section_type = 'APPENDIX'
    then regexp_replace(regexp_replace(section_name,'.* to ','','g'),'.*Part ','','g')
    else regexp_replace(section_name,'[.].+$','','g') end,4,'0') as part_id,
  case when section_type = 'APPENDIX'
    then regexp_replace(regexp_replace(section_name,' to .*','','g'),
      'Appendix |Appendixes ','Appendix-','g')
    else 'Section-' || lpad(regexp_replace(section_name,'^.+[.]','','g'),4,'0') end as section_id,
  sha256(section_text) as section_hash
from (select doc_id, title_id, section_text, t[1] as section_type,
    case when t[1] = 'APPENDIX' or contains(t[2],'.') then t[2] else '0.' || t[2] end
      as section_name
  from (select *, string_split(div_type || '-' || div_n,'-') as t from fx_div) a
  where t[1] in ('SECTION','APPENDIX')) b""",
    "shown": """
select *, case when section_type = 'SECTION' then '§ ' || section_name else section_name end
  as shown_name from sec""",
    "cleaned": """
select * replace (replace(regexp_replace(section_text,' *\\n *',' ','g'),shown_name,'')
  as section_text) from shown""",
    "words": """
select *, cast(len(string_split_regex(section_text,'\\s+')) as bigint) as section_word_count
from cleaned""",
    "vec": """
select section_hash, list_transform(embedding, lambda x: case when x = 0 then 0e0 else
    round_even(cast(x as double)
      / pow(2e0, greatest(floor(log2(abs(cast(x as double)))),-14) - 10), 0)
    * pow(2e0, greatest(floor(log2(abs(cast(x as double)))),-14) - 10) end) as v
from (select section_hash, min(doc_id) % (select count(*) from embeddings) as vec_id from sec
  where title_id like '%-2024' group by 1) k
join embeddings using (vec_id)""",
    "cen": """
select title_id, part_id, list(mean order by place) as c from (
  select title_id, part_id, place, avg(x) as mean from (
    select title_id, part_id, unnest(v) as x, generate_subscripts(v,1) as place
    from sec join vec using (section_hash) where title_id like '%-2024') a
  group by title_id, part_id, place) b
group by title_id, part_id""",
    "dev": """
select w.*, round((1e0 - list_cosine_similarity(v,c)) / 2e0, 6) as section_deviance,
  case when v is null then 0 else 1 end as focal_year_match
from words w left join vec using (section_hash)
left join (select cen.* from cen join fx_part using (title_id, part_id)) using (title_id, part_id)""",
    "joined": """
select d.* exclude (section_text, section_word_count), t.section_text, t.section_word_count
from dev d left join (select title_id, part_id, section_id, section_text, section_word_count
  from words) t using (title_id, part_id, section_id)""",
    "agg": """
select title_id, part_id, round(avg(cast(round(section_deviance * 1e6) as bigint))) / 1e6 as deviance_mean,
  count(section_id) as section_count, cast(sum(section_word_count) as bigint) as part_word_count,
  avg(focal_year_match) as focal_year_match
from joined group by title_id, part_id""",
    "part_clean": """
select title_id, part_id, part_heading, regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(part_authority,' *\\n *','','g'),'Authority: ','','g'),', and ',', ','g'),
    '.$','','g') as part_authority from fx_part""",
    "part_auth": """
select *, cast(len(string_split(part_authority,', ')) as bigint) as authority_count
from part_clean""",
    "stats": """
select * from part_auth left join agg using (title_id, part_id)""",
    "yearly": """
select * replace (regexp_replace(title_id,'-\\d{4}$','') as title_id),
  regexp_extract(title_id,'-(\\d{4})$',1) as year_id from stats""",
    "focal": """
select year_id, title_id, part_id, part_heading, part_authority, deviance_mean
from yearly where year_id = '2024'""",
    "temporal": """
select year_id, title_id, part_id, section_count, authority_count, part_word_count,
  focal_year_match
from yearly y where exists
  (select 1 from focal f where f.title_id = y.title_id and f.part_id = y.part_id)""",
    "rankable": """
select * from focal
where deviance_mean is not null and coalesce(part_heading,'') not like '%RESERVED%'""",
    "medians": """
select title_id, median(deviance_mean) as median_deviance from rankable group by title_id""",
    "roster": """
select distinct title_id, true as raw, title_id not like '%-2024' as parsed from fx_div""",
    "fetches": """
select page_id,
  case when asked then case when code = 200 then 'Acquired' else 'Failed' end else status end
    as status,
  case when asked then code else 299 end as response_code,
  asked and code = 429 as rate_limited
from (select page_id, case when page_id % 5 = 0 then 'Present' else 'Absent' end as status,
    page_id % 5 <> 0 and page_id % 4 <> 0 as asked,
    cast(case when page_id % 7 = 3 then 599 when page_id % 3 <> 0 then 200
      when page_id % 2 = 0 then 429 else 404 end as int) as code
  from pages) t""",
}

SECTION = "title_id, part_id, section_id"


def _ranked(direction: str) -> str:
    order = ", ".join(
        f"{c} {direction}" for c in ("section_deviance", "section_id", "section_hash", "section_name")
    )
    return f"""
select {SECTION}, section_hash, section_deviance, cast(r as int) as deviance_rank
from (select *, row_number() over (partition by title_id, part_id order by {order}) as r
  from dev where section_deviance is not null) t where r <= 3"""


def _notable(n: int, rows: str) -> str:
    columns = ("section_deviance", "section_id", "section_hash", "section_name", "section_text")
    low = ", ".join(f"{c} asc" for c in columns)
    high = ", ".join(f"{c} desc" for c in columns)
    return f"""
select regexp_replace(title_id,'-\\d{{4}}$','') as title_id, part_id, section_id, section_name,
  section_text, section_deviance,
  case when low <= {n} then 'Least' else 'Most' end as notable_deviant,
  regexp_extract(title_id,'-(\\d{{4}})$',1) as year_id
from (select *,
    row_number() over (partition by title_id, part_id order by {low}) as low,
    row_number() over (partition by title_id, part_id order by {high}) as high
  from {rows} where section_deviance is not null) t
where (low <= {n} or high <= {n}) and title_id like '%-2024'"""


def _panel(figure: str) -> str:
    cells = ", ".join(
        f"max(case when year_id = '{year}' then {figure} end) as \"{year}\""
        for year in (2022, 2023, 2024)
    )
    return f"select title_id, part_id, {cells} from temporal group by title_id, part_id"


def _headed(removed: str) -> str:
    return f"""
select doc_id, shown_name as section_name, {removed} as section_text
from (select s.doc_id, shown_name, regexp_replace(chr(10) || ' § ' || div_n || ' Heading. '
    || chr(10) || s.section_text,' *\\n *',' ','g') as line
  from shown s join fx_div using (doc_id)) t"""


def _propagated(more: str) -> str:
    return f"""
select s.doc_id, s.title_id, s.part_id, s.section_id, s.section_hash, v is not null as embedded,
  round(list_dot_product(v,v),6) as squared_length{more}
from sec s left join vec using (section_hash)"""


def _ids(source: str) -> str:
    return f"select doc_id, title_id, section_name, section_type, part_id, section_id from {source}"


_UNESCAPED = "title_text"
for _entity, _value in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED},'{_entity}','{_value}')"

SELECTS = {
    "ingest_roster": """
select cast(y as int) as year, cast(t as int) as title, f as filename,
  'corpus/raw/' || f as file_path,
  'https://www.ecfr.gov/api/versioner/v1/full/' || y || '-12-31/title-' || t || '.xml' as url,
  case when replace(f,'.xml.gzip','') in (select title_id from fx_div) then 'Present'
    else 'Absent' end as status
from (select y, t, 'Title-' || lpad(cast(t as varchar),2,'0') || '-' || y || '.xml.gzip' as f
  from (select unnest(range(min(cast(substr(title_id,10,4) as int)) - 1,
      max(cast(substr(title_id,10,4) as int)) + 1)) as y from fx_div) a,
    (select unnest(range(min(cast(substr(title_id,7,2) as int)),
      max(cast(substr(title_id,7,2) as int)) + 3)) as t from fx_div) b) c""",
    "classify_fetch": "select * from fetches",
    "roster_status_tally": "select status, count(*) as files from fetches group by status",
    "pending_titles": "select * from roster where not parsed",
    "extract_outcomes": """
select title_id, raw, new_lines <> -1 as parsed, new_lines from (
  select title_id, raw, cast(case when parsed then 0
    else (select count(*) from sec s where s.title_id = r.title_id) end as bigint) as new_lines
  from roster r
  union all
  select distinct substr(title_id,1,8) || '-2025', true, cast(-1 as bigint) from fx_div) t""",
    "extract_parts": """
select title_id, raw_part_id as part_id, part_heading, part_authority from fx_part""",
    "extract_sections": """
select title_id, div_type || '-' || div_n as raw_id, section_text from fx_div""",
    "page_title_text": f"""
select page_id, {_UNESCAPED} as title_text
from (select page_id, regexp_extract(html,'<title>(.*?)</title>',1) as title_text from pages) t""",
    "normalize_sections": _ids("sec"),
    "normalize_sections_repaired": """
select doc_id, title_id, section_name, section_type,
  'Part-' || case when length(x) < 4 then lpad(x,4,'0') else x end as part_id,
  case when section_type = 'APPENDIX' then y
    else 'Section-' || case when length(y) < 4 then lpad(y,4,'0') else y end end as section_id
from (select *, case when section_type = 'APPENDIX'
      then regexp_replace(regexp_replace(section_name,'.* to ',''),'.*Part ','')
      else regexp_replace(section_name,'[.].+$','') end as x,
    case when section_type = 'APPENDIX'
      then regexp_replace(regexp_replace(section_name,' to .*',''),'Appendix |Appendixes ',
        'Appendix-')
      else regexp_replace(section_name,'^.+[.]','') end as y
  from (select doc_id, title_id, div_type as section_type,
      case when div_type = 'APPENDIX' or contains(div_n,'.') then div_n else '0.' || div_n end
        as section_name
    from fx_div where div_type <> 'NOTE') a) b""",
    "normalize_appendices": _ids("sec") + " where section_type = 'APPENDIX'",
    "ordered_sections": """
select title_id, section_name, section_type, part_id, section_id from sec
order by title_id, part_id, section_type desc, section_id""",
    "compile_parts": "select title_id, part_id, part_heading, part_authority from fx_part",
    "roundtrip_parquet": """
select doc_id, section_name, section_type, part_id, section_id, section_hash, title_id from sec""",
    "section_hash": "select doc_id, sha256(section_text) as section_hash from fx_div",
    "clean_section_text": _headed("replace(line,shown_name,'')"),
    "clean_section_text_regex": _headed("regexp_replace(line,shown_name,'','g')"),
    "section_word_count": "select doc_id, section_word_count from words",
    "clean_authority": "select title_id, part_id, part_authority from part_clean",
    "authority_count": "select title_id, part_id, authority_count from part_auth",
    "split_title_year": """
select doc_id, regexp_replace(title_id,'-\\d{4}$','') as title_id,
  regexp_extract(title_id,'-(\\d{4})$',1) as year_id from fx_div""",
    "focal_counts": """
select (select count(*) from sec) as section_count,
  (select count(*) from sec where title_id like '%2024%') as section_count_now,
  (select count(*) from fx_part) as part_count,
  (select count(*) from fx_part where title_id like '%2024%') as part_count_now""",
    "quantize_half": """
select vec_id, cast(unnest(range(len(embedding))) as int) as place,
  unnest(list_transform(embedding, lambda x: case when x = 0 then 0e0 else
    round_even(cast(x as double)
      / pow(2e0, greatest(floor(log2(abs(cast(x as double)))),-14) - 10), 0)
    * pow(2e0, greatest(floor(log2(abs(cast(x as double)))),-14) - 10) end)) as half_value
from embeddings""",
    "embed_sections": """
select section_hash, cast(bucket as int) as place,
  round(n / sqrt(sum(n * n) over (partition by section_hash)), 6) as weight
from (select section_hash, bucket, cast(count(*) as double) as n
  from (select section_hash, cast('0x' || substr(md5(word),1,8) as bigint) % 64 as bucket
    from (select section_hash, unnest(string_split_regex(section_text,'\\s+')) as word
      from (select distinct section_hash, section_text from sec
        where title_id like '%-2024') a) b) c
  group by section_hash, bucket) d""",
    "propagate_embeddings": _propagated(""),
    "propagate_embeddings_copies": _propagated(""", greatest(1, (select count(*) from sec f
    where f.section_hash = s.section_hash and f.title_id like '%-2024' and v is not null))
    as copies"""),
    "part_centroid": """
select title_id, part_id, cast(unnest(range(len(c))) as int) as place,
  round(unnest(c),6) as mean from cen""",
    "part_centroid_join": """
select title_id, part_id, part_heading, c is not null as averaged,
  round(sqrt(list_dot_product(c,c)),6) as part_norm
from fx_part left join cen using (title_id, part_id)""",
    "section_deviance": f"select doc_id, {SECTION}, section_hash, section_deviance from dev",
    "attach_text_counts": f"""
select doc_id, {SECTION}, count(*) as text_rows,
  cast(sum(section_word_count) as bigint) as joined_words
from joined group by doc_id, {SECTION}""",
    "least_deviant": _ranked("asc"),
    "most_deviant": _ranked("desc"),
    "labelled_sections": f"""
select doc_id, {SECTION}, section_name, section_hash, section_deviance,
  case when section_deviance is null then 'Neither' when low <= 3 then 'Least'
    when high <= 3 then 'Most' else 'Neither' end as notable_deviant
from (select *,
    row_number() over (partition by title_id, part_id, section_deviance is null order by
      section_deviance, section_id, section_hash, section_name, doc_id) as low,
    row_number() over (partition by title_id, part_id, section_deviance is null order by
      section_deviance desc, section_id desc, section_hash desc, section_name desc, doc_id desc)
      as high
  from dev) t""",
    "notable_sections": _notable(1, "joined"),
    "notable_sections_three": _notable(3, "joined"),
    "notable_sections_own_text": _notable(3, "dev"),
    "part_deviance": "select title_id, part_id, deviance_mean, section_count from agg",
    "part_word_count": "select title_id, part_id, part_word_count from agg",
    "focal_year_match": "select title_id, part_id, focal_year_match from agg",
    "part_statistics": "select * from stats",
    "part_statistics_own_text": """
select * from part_auth left join (
  select title_id, part_id, round(avg(cast(round(section_deviance * 1e6) as bigint))) / 1e6 as deviance_mean,
    count(section_id) as section_count, cast(sum(section_word_count) as bigint) as part_word_count,
    avg(focal_year_match) as focal_year_match
  from dev group by title_id, part_id) using (title_id, part_id)""",
    "part_statistics_copies": """
select * from part_auth left join (
  select title_id, part_id, round(avg(cast(round(section_deviance * 1e6) as bigint))) / 1e6 as deviance_mean,
    count(section_id) as section_count, cast(sum(section_word_count) as bigint) as part_word_count,
    avg(focal_year_match) as focal_year_match
  from joined j left join (select s.section_hash from sec s join vec using (section_hash)
    where title_id like '%-2024') using (section_hash)
  group by title_id, part_id) using (title_id, part_id)""",
    "part_focal": "select * from focal",
    "part_temporal": "select * from temporal",
    "panel_sections": _panel("section_count"),
    "panel_authorities": _panel("authority_count"),
    "panel_words": _panel("part_word_count"),
    "panel_match": _panel("focal_year_match"),
    "title_median_deviance": """
select title_id, round(median_deviance,9) as median_deviance from medians""",
    "noteworthy_part": """
select title_id, part_id, deviance_mean from rankable
where title_id = (select title_id from medians order by median_deviance desc, title_id limit 1)
order by deviance_mean desc, part_id limit 1""",
    "focal_display_scores": """
select title_id, part_id, round_even(deviance_mean,3) as deviance_mean from focal""",
    "enrich_titles": """
select f.* replace (round_even(deviance_mean,3) as deviance_mean), title_name_full
from focal f left join titles using (title_id)""",
    "part_lookup": """
select title_name_full, part_heading, part_authority, round_even(deviance_mean,3) as deviance_mean
from focal left join titles using (title_id)
where title_id = 'Title-01' and part_id = 'Part-0003'""",
    "dropdown_options": """
select distinct regexp_replace(title_id,'^([A-Za-z]+)-0*','\\1 ') as label, title_id as value
from focal
union all
select distinct regexp_replace(part_id,'^([A-Za-z]+)-0*','\\1 '), part_id
from focal where title_id = 'Title-01'""",
    "deviance_distribution": """
select title_id, part_id, deviance_mean,
  row_number() over (order by deviance_mean desc nulls last, part_id) - 1 as position,
  part_id = 'Part-0003' as highlighted, replace(part_id,'Part-','') as part_number
from focal where title_id = 'Title-01'""",
}


def oracle(name: str) -> str:
    """One self-contained statement: the blocks it needs, then its select."""
    needed, todo = set(), [SELECTS[name]]
    while todo:
        sql = todo.pop()
        for block, body in BLOCKS.items():
            if block not in needed and _mentions(sql, block):
                needed.add(block)
                todo.append(body)
    blocks = ",\n".join(f"{b} as ({body})" for b, body in BLOCKS.items() if b in needed)
    return f"with {blocks}\n{SELECTS[name].strip()}" if blocks else SELECTS[name].strip()


def _mentions(sql: str, block: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(a in ("from", "join") and b == block for a, b in zip(words, words[1:], strict=False))
