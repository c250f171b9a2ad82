"""Reference lists.

All of this module is fixed values: lists that results depend on, in their natural
order. Order counts for BRANDS only (the first of equal matches wins). Callers can
replace any of them by a list of their own, see ``sources.lists``.
"""

#: Brand names looked for in hostnames; the order breaks ties.
BRANDS = tuple(
    """
    1password acrobat adobe akamai alibaba aliexpress amazon americanexpress amex apple atlassian att aws
    azure bankofamerica barclays binance bitbucket bitwarden capitalone cashapp chase cisco citi citibank
    cloudflare coinbase comcast confluence crowdstrike dell dhl discord disney docusign drive dropbox duo ebay
    etsy facebook fastly fedex fidelity fortinet github gitlab gmail google googlemail hp hsbc hulu ibm icloud
    instagram intuit jira kaspersky keepass kraken lastpass lenovo linkedin mastercard mcafee meta microsoft
    netflix norton notion office office365 okta onedrive oracle outlook paloalto paramount paypal pinterest
    quickbooks reddit robinhood salesforce samsung sap schwab sentinelone servicenow sharepoint shopify slack
    snapchat sony sophos spotify square stripe symantec target teams telegram tiktok tmobile turbotax twitch
    twitter ups usps vanguard venmo verizon visa walmart wellsfargo whatsapp workday xfinity youtube zelle
    zoom
    """.split()
)

#: Words that lure people to act.
LURES = tuple(
    """
    urgent alert immediate action required attention notice expiration expire expired warning suspension
    suspended update verify verification validate validation secure security confirm confirmation review
    important resolve unblock unlock restricted compromised disabled terminate termination pending invoice
    payment bill billing receipt transaction charge refund statement balance transfer funds deposit withdrawal
    wire ach settlement overdraft fee unpaid overdue credit debit card tax taxes revenue customs return audit
    assessment account login logon signin password passcode pin credential credentials access profile settings
    preference recover recovery reset mfa otp token authenticate authentication session payroll salary wage
    bonus compensation benefits employee employer staff directory handbook policy survey appraisal evaluation
    severance payslip stub contract agreement nda proposal quote po purchaseorder rfp vendor supplier document
    doc pdf file files attachment shared share drive folder spreadsheet presentation signature sign signed
    draft confidential private memo report fax efax scan scanned voicemail vm audio transcript message email
    mail inbox quota limit storage bounced delivery undelivered notification ticket request inquiry support
    helpdesk new online portal web system app application network gateway intranet extranet vpn remote upgrade
    patch maintenance cancel cancellation order tracking parcel shipment shipping trackingnumber trackinginfo
    eform compliance mandatory strict info final
    """.split()
)

#: Registrable domains of content networks.
CDNS = tuple(
    """
    cloudfront.net fastly.net cloudflare.com akamaiedge.net edgecastcdn.net msecnd.net azureedge.net hwcdn.net
    cdngc.net akamaihd.net edgesuite.net llnwd.net cdn77.org bunny.net keycdn.com sucuri.net impervadns.net
    incapsula.com stackpathdns.com section.io belugacdn.com cachefly.net edg.io gcore.com
    """.split()
)

#: Free or instant hosting that is often abused; some entries have three or more labels.
ABUSED_HOSTING = tuple(
    """
    github.io raw.githubusercontent.com netlify.app vercel.app web.app firebaseapp.com herokuapp.com pages.dev
    render.com onrender.com repl.co replit.app replit.dev workers.dev surge.sh discordapp.com weebly.com
    wixsite.com wordpress.com blogspot.com carrd.co neocities.org alwaysdata.net infinityfree.net
    000webhostapp.com pantheonsite.io appspot.com azurewebsites.net amazonaws.com googleapis.com
    sites.google.com storage.googleapis.com windows.net blob.core.windows.net fly.dev dathost.net railway.app
    cyclic.app glitch.me b4a.app supabase.co amplifyapp.com bounceme.net duckdns.org hopto.org edgeone.app
    ngrok.io
    """.split()
)

#: Suffixes of low risk.
SAFE_TLDS = tuple(
    """
    .ac.in .ac.jp .app .arpa .asia .at .au .be .ca .ch .co .co.in .co.jp .co.kr .co.nz .co.uk .co.za .com
    .com.ar .com.au .com.br .com.mx .com.sg .de .dev .dk .edu .edu.au .edu.sg .eu .fi .fr .go.jp .go.kr
    .gob.mx .gov .gov.ar .gov.au .gov.br .gov.in .gov.sg .gov.za .govt.nz .ie .int .io .jp .ltd.uk .me.uk .mil
    .ne.jp .ne.kr .net .net.ar .net.au .net.br .net.in .net.mx .net.nz .net.sg .net.uk .net.za .nl .no .nz
    .or.jp .or.kr .org .org.ar .org.au .org.br .org.in .org.mx .org.nz .org.sg .org.uk .org.za .plc.uk .se .uk
    .us .in
    """.split()
)

#: Suffixes of medium risk; they come before the safe ones.
MEDIUM_TLDS = tuple(
    """
    .app .biz .blog .cc .global .info .life .live .me .media .mobi .name .news .pro .pw .site .store .tech
    .tel .today .tv .world .zone .cloud .ai
    """.split()
)

#: Public suffixes of two labels, for splitting hostnames.
TWO_LABEL_SUFFIXES = tuple(
    """
    co.in net.in org.in gen.in firm.in ind.in ac.in edu.in res.in gov.in mil.in nic.in co.uk org.uk me.uk
    net.uk ltd.uk plc.uk ac.uk gov.uk sch.uk nhs.uk police.uk com.au net.au org.au asn.au id.au edu.au gov.au
    csiro.au com.br net.br org.br gov.br edu.br adm.br blog.br emp.br far.br imb.br co.nz net.nz org.nz
    govt.nz ac.nz co.za net.za org.za gov.za ac.za co.jp ne.jp or.jp go.jp ac.jp ad.jp ed.jp gr.jp lg.jp
    com.cn net.cn org.cn gov.cn edu.cn com.hk net.hk org.hk gov.hk edu.hk com.sg net.sg org.sg gov.sg edu.sg
    com.my net.my org.my gov.my edu.my com.pk net.pk org.pk gov.pk edu.pk com.bd net.bd org.bd gov.bd edu.bd
    com.lk net.lk org.lk gov.lk edu.lk com.ar net.ar org.ar gov.ar edu.ar com.mx net.mx org.mx gob.mx edu.mx
    com.co net.co org.co gov.co edu.co com.es org.es nom.es gob.es edu.es co.it com.fr co.de com.ru net.ru
    org.ru com.ae net.ae org.ae gov.ae edu.ae com.sa net.sa org.sa gov.sa edu.sa com.ng net.ng org.ng gov.ng
    edu.ng co.ke or.ke ne.ke go.ke ac.ke com.eg net.eg org.eg gov.eg edu.eg com.tr net.tr org.tr gov.tr edu.tr
    co.th net.th org.th go.th ac.th co.id net.id or.id go.id ac.id com.ph net.ph org.ph gov.ph edu.ph com.vn
    net.vn org.vn gov.vn edu.vn com.ve net.ve org.ve info.ve co.ve
    """.split()
)

#: Public suffixes of two labels, for the risk of a top-level domain (a smaller list).
TLD_TWO_LABEL_SUFFIXES = tuple(
    """
    co.uk org.uk me.uk net.uk ltd.uk plc.uk gov.uk ac.uk sch.uk nhs.uk co.in org.in net.in gov.in ac.in edu.in
    com.au org.au net.au gov.au edu.au co.nz org.nz net.nz govt.nz co.za org.za net.za gov.za com.br org.br
    net.br gov.br co.jp or.jp ne.jp go.jp ac.jp co.kr or.kr ne.kr go.kr com.sg org.sg gov.sg com.mx gob.mx
    com.ar org.ar
    """.split()
)

#: Words of credential phishing in a path or query.
PATH_KEYWORDS = tuple(
    """
    login signin sign-in log-in logon verify verification validate validation secure security update confirm
    confirmation account password passwd credential credentials authorize auth oauth token session reset
    recover unlock activate activation checkout payment billing invoice webmail portal support helpdesk admin
    administrator wp-admin cpanel bank banking wallet crypto bitcoin
    """.split()
)

#: Names of parameters that redirect.
REDIRECT_PARAMETERS = tuple(
    """
    redirect redirect_uri redirect_url return returnurl return_url next target destination dest url goto go
    link forward continue callback ref
    """.split()
)

#: Hostname tokens that name infrastructure, not a brand.
INFRA_TOKENS = tuple(
    """
    ssl api cdn dev img mail www static global edge assets cloud login portal smtp cdn1 cdn2 fastly-edge
    fastly cloudfront akamai
    """.split()
)

#: Content networks that brand similarity knows (a smaller list than CDNS).
BRAND_CDNS = tuple(
    """
    fastly.net cloudfront.net azureedge.net vercel.app netlify.app github.io
    """.split()
)

#: Parts of provider names that are often abused.
ABUSED_PROVIDERS = tuple(
    """
    digitalocean linode vultr choopa m247 hetzner ovh amazon aws google azure microsoft alibaba tencent
    """.split()
)

#: Parts of cloud provider names.
CLOUD_PROVIDERS = tuple(
    """
    amazon aws azure microsoft google gcp digitalocean linode akamai vultr hetzner ovh oracle alibaba tencent
    ibm cloudflare
    """.split()
)

#: Parts of ransomware names.
RANSOMWARE_WORDS = tuple(
    """
    lockbit blackcat conti ransom ryuk darkside revil sodinokibi hive blackmatter clop maze netwalker dharma
    phobos
    """.split()
)

#: Tags that raise the score of a file hash.
HASH_RISK_TAGS = tuple(
    """
    ransomware stealer loader botnet infostealer trojan
    """.split()
)

#: Factors that count as signals of structure.
STRUCTURAL_FACTORS = tuple(
    """
    brand_impersonation_high hostname_brand_cdn hostname_brand_direct tls_very_new tls_new young_domain
    young_domain_mid high_entropy moderate_entropy subdomain_high_entropy subdomain_v2_high
    subdomain_v2_moderate rapid_deployment_host tld_high_risk tld_high_corr token_abused_hosting
    token_abused_hosting_brand
    """.split()
)
