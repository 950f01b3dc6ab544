"""Fixed schemas; production paths never infer."""

PAGE = """url string, final_url string, status int, content_type string, error string, error_type string, depth int,
redirect_chain array<struct<url:string,status:int,location:string>>, title string, meta_description string, meta_robots string,
x_robots_tag string, canonical string, h1 array<string>, h2 array<string>, lang string, hreflang array<struct<hreflang:string,href:string>>,
internal_links array<string>, external_links array<string>, nofollow_links array<string>, images int, images_missing_alt int,
json_ld_types array<string>, json_ld_errors array<string>, og map<string,string>, twitter map<string,string>, word_count int,
content_hash string, fetched_at double"""

FINDING = "type string, severity string, url string, detail string, evidence map<string,string>, report string, run_date string"
