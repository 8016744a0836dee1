"""SQL text shared by the oracles."""


def head(u):
    return f"regexp_extract({u},'^([^?#]*)',1)"


def qs(u):
    return f"regexp_extract({u},'^[^?#]*[?]([^#]*)',1)"


def frag(u):
    return f"regexp_extract({u},'(#.+)$',1)"


def netloc(u):
    return f"regexp_extract({u},'^[a-z]+://([^/?#]*)',1)"


def host(u):
    return f"regexp_replace(lower({netloc(u)}),'^www[.]','')"


def path(u):
    return f"regexp_extract({u},'^[a-z]+://[^/?#]*([^?#]*)',1)"


def _key(p):
    return f"regexp_extract({p},'^([^=]*)',1)"


def canonical(u):
    keys = "('igsh','igshid','fbclid','ref','share_id')"
    kept = (f"list_filter(string_split({qs(u)},'&'), lambda p: p<>'' and not "
            f"(starts_with({_key('p')},'utm_') or {_key('p')} in {keys}))")
    ranked = (f"list_sort(list_transform({kept}, lambda p, i: {{'a': list_position(list_transform({kept}, "
              f"lambda z: {_key('z')}), {_key('p')}), 'b': i, 'c': replace(p,'%20','+')}}))")
    q = f"array_to_string(list_transform({ranked}, lambda s: s.c),'&')"
    return f"({head(u)} || CASE WHEN {q}='' THEN '' ELSE '?' || {q} END || {frag(u)})"


def clean(u):
    keys = ("('fbclid','gclid','mc_cid','mc_eid','igshid','igsh','aem','_aem','ref','ref_src')")
    k = f"lower({_key('p')})"
    kept = (f"list_filter(string_split({qs(u)},'&'), lambda p: p<>'' and not "
            f"(starts_with({k},'utm_') or {k} in {keys}))")
    q = f"replace(array_to_string({kept},'&'),'%20','+')"
    return (f"(CASE WHEN {qs(u)}='' THEN {u} ELSE {head(u)} || CASE WHEN {q}='' THEN '' "
            f"ELSE '?' || {q} END || {frag(u)} END)")


def platform(u):
    h = host(u)
    return (f"CASE WHEN {h} IN ('reddit.com','redd.it') OR {h} LIKE '%.reddit.com' THEN 'reddit' "
            f"WHEN {h} IN ('youtube.com','youtu.be') OR {h} LIKE '%.youtube.com' THEN 'youtube' "
            f"WHEN {h}='instagram.com' OR {h} LIKE '%.instagram.com' THEN 'instagram' "
            f"WHEN {h} IN ('tiktok.com') OR {h} LIKE '%.tiktok.com' THEN 'tiktok' "
            f"WHEN {h} IN ('facebook.com','fb.com','fb.watch') OR {h} LIKE '%.facebook.com' "
            f"THEN 'facebook' ELSE 'generic' END")
