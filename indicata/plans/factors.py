"""The registry of risk factors: fixed values (key, documented maximum, label), in their natural order."""

FACTORS = {
    "hash_low_detection": (20, "Low engine detection count"),
    "hash_medium_detection": (40, "Moderate engine detection count"),
    "hash_high_detection": (60, "High engine detection count"),
    "hash_very_high_detection": (80, "Very high engine detection count"),
    "hash_confirmed_malware": (95, "Confirmed malware (50+ engines)"),
    "hash_otx_pulses": (5, "High OTX pulse activity for hash (>10 pulses)"),
    "hash_otx_families": (5, "Malware families identified via OTX"),
    "hash_otx_malware_families": (20, "Malware families identified via OTX"),
    "hash_otx_pulse_strength": (15, "Hash referenced in multiple OTX pulses"),
    "hash_otx_high_risk_tags": (10, "High-risk malware classification tags"),
    "hash_otx_file_score": (30, "OTX behavioral malware score"),
    "vt_single_detection": (10, "Single engine flagged malicious"),
    "vt_domain_low": (25, "VT: 2-4 engines flagged malicious"),
    "vt_domain_medium": (35, "VT: 5-9 engines flagged malicious"),
    "vt_domain_high": (45, "VT: 10-19 engines flagged malicious"),
    "vt_domain_critical": (55, "VT: 20+ engines flagged malicious"),
    "vt_medium_detection": (35, "Multiple engines flagged IP malicious (medium)"),
    "vt_high_detection": (40, "Many engines flagged IP malicious (high)"),
    "vt_critical_detection": (45, "Critical multi-engine IP malicious verdict"),
    "abuse_low_band": (10, "AbuseIPDB low-confidence abuse report"),
    "abuse_mid_band": (20, "AbuseIPDB medium-confidence abuse report"),
    "abuse_high_band": (30, "AbuseIPDB high-confidence abuse report"),
    "otx_ip_malware": (30, "Malware families linked to IP (OTX)"),
    "malware_infrastructure_confirmed": (20, "Confirmed malware infrastructure (multi-family + VT)"),
    "ransomware_infrastructure": (15, "Ransomware-linked infrastructure"),
    "subnet_cluster_activity": (12, "Suspicious infrastructure cluster in same /24 subnet"),
    "asn_abuse_context": (8, "Infrastructure hosted on commonly abused ASN"),
    "otx_ip_pulses": (10, "High OTX pulse activity for IP (>5 pulses)"),
    "cloud_abuse_pattern": (10, "Cloud-hosted IP with VT malicious verdicts"),
    "multi_feed_consensus": (15, "Multi-feed consensus: VT + AbuseIPDB + OTX"),
    "high_abuse_confidence": (20, "AbuseIPDB confidence > 50%"),
    "low_abuse_confidence": (5, "AbuseIPDB confidence 5-50%"),
    "tor_exit_node": (15, "TOR exit node"),
    "young_domain": (30, "Domain age < 30 days"),
    "young_domain_mid": (10, "Domain age 30-90 days"),
    "young_domain_low": (5, "Domain age 90-180 days"),
    "tls_very_new": (10, "TLS certificate < 7 days old"),
    "tls_new": (5, "TLS certificate < 30 days old"),
    "rapid_deployment_host": (10, "Rapid deployment hosting"),
    "otx_strong": (20, "Recent malware activity (OTX)"),
    "otx_suspicious": (10, "High-risk threat intelligence tags"),
    "otx_contextual": (3, "Referenced in threat intelligence"),
    "otx_vt_correlation": (10, "Correlated multi-source detection (VT>=2 + OTX)"),
    "vt_otx_corroboration": (15, "Strong multi-source corroboration (VT>=5 + OTX)"),
    "brand_impersonation_high": (15, "High-confidence brand impersonation"),
    "brand_impersonation_med": (8, "Medium-confidence brand impersonation"),
    "hostname_brand_cdn": (20, "Brand impersonation in subdomain on CDN"),
    "hostname_brand_direct": (12, "Brand impersonation in subdomain label"),
    "cdn_abuse_pattern": (15, "CDN-hosted domain with brand impersonation or VT detections"),
    "subdomain_high_entropy": (10, "High-entropy subdomain label (possible DGA/random)"),
    "subdomain_v2_high": (10, "High-entropy subdomain (v2): consistent with DGA or random generation"),
    "subdomain_v2_moderate": (5, "Moderate-entropy subdomain (v2): elevated randomness, warrants review"),
    "brand_tls_correlation": (15, "Brand impersonation + fresh TLS cert"),
    "brand_entropy_correlation": (5, "Brand impersonation + high domain entropy"),
    "brand_otx_correlation": (10, "Brand impersonation confirmed by OTX"),
    "behavioral_pattern_detected": (10, "Multi-signal suspicious infrastructure"),
    "subdomain_explosion_high": (10, "Subdomain explosion (>25)"),
    "subdomain_explosion_low": (5, "Elevated subdomains (>10)"),
    "high_entropy": (5, "High domain entropy (possible DGA)"),
    "moderate_entropy": (2, "Moderate domain entropy"),
    "tld_high_risk": (15, "High-risk TLD (associated with abusive campaign infrastructure)"),
    "tld_moderate_risk": (5, "Moderate-risk TLD (elevated abuse prevalence)"),
    "tld_high_corr": (10, "High-risk TLD + structural corroboration (brand / lure / young domain)"),
    "token_multi_brand": (20, "Multiple brand tokens in hostname (combination impersonation)"),
    "token_brand_cdn_lure": (30, "Brand + CDN hosting + lure keyword: high-risk phishing infrastructure"),
    "token_brand_subdomain": (10, "Brand token in subdomain label"),
    "token_lure_detected": (8, "Phishing lure keywords present in hostname"),
    "token_abused_hosting": (8, "Known abused/free hosting platform (phishing infrastructure risk)"),
    "token_abused_hosting_brand": (15, "Brand token on known abused hosting platform"),
    "subdomain_depth_signal": (5, "Deep subdomain chain detected (≥3 levels)"),
    "redirect_chain_suspicious": (10, "Redirect chain terminates in high-risk infrastructure"),
    "url_suspicious_scheme": (15, "Suspicious URL scheme (non-HTTP/S)"),
    "url_ip_host": (8, "IP address used as URL host"),
    "url_path_keywords_high": (10, "Multiple high-risk path keywords (login/verify/secure/account)"),
    "url_path_keywords": (5, "Suspicious path keyword detected"),
    "url_very_long_path": (5, "Unusually long URL path (>300 chars)"),
    "url_long_path": (2, "Long URL path (>120 chars)"),
    "url_encoded_params": (5, "Percent-encoded parameter sequences in URL"),
    "url_base64_query": (3, "Base64-encoded value in query string"),
    "url_open_redirect": (8, "Open-redirect parameter name present"),
    "url_double_slash": (10, "Double-slash path confusion (//domain in path)"),
    "url_brand_in_path": (10, "Brand/domain token embedded in URL path"),
    "url_random_token": (3, "Long random/hex token in URL path"),
    "url_in_query_string": (8, "Full URL embedded in query string"),
}
