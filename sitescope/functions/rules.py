"""Detection rules as data.

Both texts below hold fixed values: names, categories, confidences and patterns
have to equal the published rule set for results to agree. One line per pattern;
lines of the same name form one rule, and line order is rule and pattern order.
The pattern is the last field and may itself contain ``|``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

HTML, HEADER, GENERATOR = "html", "header", "meta_gen"

# name | category | kind | header | confidence | pattern
TECHNOLOGY_RULES_TEXT = r"""
WordPress | CMS | html | | 0.9 | /wp-content/
WordPress | CMS | html | | 0.9 | /wp-json/
WordPress | CMS | meta_gen | | 0.95 | WordPress(?:\s+(?P<version>[\d.]+))?
WooCommerce | E-commerce | html | | 0.85 | woocommerce
Shopify | E-commerce | html | | 0.95 | cdn\.shopify\.com
Shopify | E-commerce | html | | 0.9 | Shopify\.theme
Magento | E-commerce | html | | 0.85 | /static/version\d+/frontend/
Magento | E-commerce | html | | 0.7 | Magento
Drupal | CMS | html | | 0.8 | /sites/(?:all|default)/
Drupal | CMS | meta_gen | | 0.95 | Drupal(?:\s+(?P<version>[\d.]+))?
Joomla | CMS | meta_gen | | 0.95 | Joomla
Joomla | CMS | html | | 0.8 | /media/jui/
React | JavaScript Framework | html | | 0.85 | data-reactroot
React | JavaScript Framework | html | | 0.7 | /static/js/react
Angular | JavaScript Framework | html | | 0.9 | ng-version=\"(?P<version>[\d.]+)\"
Angular | JavaScript Framework | html | | 0.6 | ng-app
Vue.js | JavaScript Framework | html | | 0.75 | data-v-[0-9a-f]{8}
Vue.js | JavaScript Framework | html | | 0.7 | vue(?:\.min)?\.js
Next.js | JavaScript Framework | html | | 0.9 | /_next/static/
Next.js | JavaScript Framework | html | | 0.9 | __NEXT_DATA__
Nuxt.js | JavaScript Framework | html | | 0.9 | /_nuxt/
Nuxt.js | JavaScript Framework | html | | 0.9 | __NUXT__
Laravel | Web Framework | header | set-cookie | 0.9 | laravel_session
Laravel | Web Framework | html | | 0.4 | csrf-token
HubSpot | CRM | html | | 0.9 | js\.hs-scripts\.com
HubSpot | CRM | html | | 0.6 | hsubspot|hs-analytics
Salesforce | CRM | html | | 0.6 | salesforce\.com
Salesforce | CRM | html | | 0.7 | pardot
Cloudflare | CDN / Hosting | header | cf-ray | 0.95 | .+
Cloudflare | CDN / Hosting | header | server | 0.9 | cloudflare
Google Tag Manager | Tag Manager | html | | 0.95 | googletagmanager\.com/gtm\.js
Google Tag Manager | Tag Manager | html | | 0.9 | GTM-[A-Z0-9]+
Google Analytics | Analytics | html | | 0.9 | google-analytics\.com/analytics\.js
Google Analytics | Analytics | html | | 0.9 | UA-\d{4,}-\d+
Google Analytics 4 | Analytics | html | | 0.95 | gtag/js\?id=G-[A-Z0-9]+
Google Analytics 4 | Analytics | html | | 0.75 | G-[A-Z0-9]{6,}
Meta Pixel | Marketing Pixel | html | | 0.95 | connect\.facebook\.net/.+/fbevents\.js
Meta Pixel | Marketing Pixel | html | | 0.9 | fbq\('init'
LinkedIn Insight Tag | Marketing Pixel | html | | 0.95 | snap\.licdn\.com/li\.lms-analytics
LinkedIn Insight Tag | Marketing Pixel | html | | 0.9 | _linkedin_partner_id
TikTok Pixel | Marketing Pixel | html | | 0.95 | analytics\.tiktok\.com
Hotjar | Analytics | html | | 0.95 | static\.hotjar\.com
Hotjar | Analytics | html | | 0.6 | hjid
Microsoft Clarity | Analytics | html | | 0.95 | clarity\.ms
Intercom | Chat / Widget | html | | 0.95 | widget\.intercom\.io
Drift | Chat / Widget | html | | 0.95 | js\.driftt\.com
Tawk.to | Chat / Widget | html | | 0.95 | embed\.tawk\.to
"""

# name | category | pattern
MARKETING_RULES_TEXT = r"""
Google Ads | Advertising | googleadservices\.com/pagead/conversion
Google Ads | Advertising | gtag/js\?id=AW-
Google Ads | Advertising | AW-\d{6,}
Google Analytics 4 | Analytics | gtag/js\?id=G-[A-Z0-9]+
Google Tag Manager | Tag Manager | googletagmanager\.com/gtm\.js
Google Tag Manager | Tag Manager | GTM-[A-Z0-9]+
Meta Pixel | Marketing Pixel | connect\.facebook\.net/.+/fbevents\.js
Meta Pixel | Marketing Pixel | fbq\('init'
LinkedIn Insight Tag | Marketing Pixel | snap\.licdn\.com/li\.lms-analytics
LinkedIn Insight Tag | Marketing Pixel | _linkedin_partner_id
TikTok Pixel | Marketing Pixel | analytics\.tiktok\.com
Hotjar | Analytics | static\.hotjar\.com
Microsoft Clarity | Analytics | clarity\.ms
Intercom | Chat / Widget | widget\.intercom\.io
Drift | Chat / Widget | js\.driftt\.com
Tawk.to | Chat / Widget | embed\.tawk\.to
Crisp | Chat / Widget | client\.crisp\.chat
Mailchimp | Lead / Newsletter Form | list-manage\.com
Mailchimp | Lead / Newsletter Form | chimpstatic\.com
HubSpot Forms | Lead / Newsletter Form | js\.hsforms\.net
HubSpot Forms | Lead / Newsletter Form | forms\.hsforms\.com
Newsletter / Lead Form | Lead / Newsletter Form | <input[^>]+type=[\"']email[\"']
Newsletter / Lead Form | Lead / Newsletter Form | name=[\"']email[\"']
OneTrust | Cookie / Consent | cdn\.cookielaw\.org
OneTrust | Cookie / Consent | onetrust
Cookiebot | Cookie / Consent | consent\.cookiebot\.com
Cookie Consent | Cookie / Consent | cookieconsent
OptinMonster | Popup | optinmonster
Privy | Popup | privy\.com
WhatsApp | Messaging | wa\.me/
WhatsApp | Messaging | api\.whatsapp\.com
WhatsApp | Messaging | whatsapp://
Calendly | Appointment Booking | calendly\.com
Acuity Scheduling | Appointment Booking | acuityscheduling\.com
"""

# Fixed value: how a page names its generator.
GENERATOR_PATTERN = (
    r"<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)[\"']"
)


@dataclass(frozen=True)
class RulePattern:
    """One indicator of a tool. ``rule`` and ``position`` are its place in the set."""

    rule: int
    position: int
    name: str
    category: str
    pattern: str
    kind: str = HTML
    header: str = ""
    confidence: float = 0.8

    @property
    def has_version(self) -> bool:
        return "(?P<version>" in self.pattern

    @property
    def version_group(self) -> int:
        return re.compile(self.pattern).groupindex.get("version", 0)

    @property
    def evidence(self) -> str:
        return f"{self.kind}:{self.pattern}"


def _numbered(rows: Iterable[dict]) -> tuple[RulePattern, ...]:
    found: list[RulePattern] = []
    for row in rows:
        same = bool(found) and found[-1].name == row["name"]
        rule = (found[-1].rule + (0 if same else 1)) if found else 0
        position = found[-1].position + 1 if same else 0
        found.append(RulePattern(rule=rule, position=position, **row))
    return tuple(found)


def technology_rules(text: str = TECHNOLOGY_RULES_TEXT) -> tuple[RulePattern, ...]:
    """Technology patterns in rule order; pass another text to replace the set."""

    def rows():
        for line in filter(None, map(str.strip, text.splitlines())):
            name, category, kind, header, confidence, pattern = (
                part.strip() for part in line.split("|", 5)
            )
            yield {
                "name": name,
                "category": category,
                "kind": kind,
                "header": header.lower(),
                "confidence": float(confidence or 0.8),
                "pattern": pattern,
            }

    return _numbered(rows())


def marketing_rules(text: str = MARKETING_RULES_TEXT) -> tuple[RulePattern, ...]:
    """Marketing patterns in rule order; they only ever look at HTML."""

    def rows():
        for line in filter(None, map(str.strip, text.splitlines())):
            name, category, pattern = (part.strip() for part in line.split("|", 2))
            yield {"name": name, "category": category, "pattern": pattern}

    return _numbered(rows())


def java_regex(pattern: str) -> str:
    """The same search in Java: ignore case in Unicode, ``.`` stops at newline only."""
    return "(?iud)" + pattern.replace("(?P<", "(?<")


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case texts of which every match contains at least one; None if unknown.

    One text per outer alternative. Only plain characters outside groups and classes
    count, and one that a quantifier may drop is taken back. A coded escape or an
    escape inside a class gives up, which only costs speed.
    """
    if re.search(r"\\[xuUN0-9]|\[[^\]]*\\[\[\]]", pattern):
        return None
    branches, runs, run, depth, i = [], [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        literal = None
        if ch == "\\":
            i += 1
            literal = None if pattern[i].isalnum() else pattern[i]
        elif ch == "[":
            i = pattern.index("]", i + 2)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            branches.append([*runs, run])
            runs, run = [], ""
        elif ch in "?*{":
            run = run[:-1]
            i = pattern.index("}", i) if ch == "{" else i
        elif ch not in "+.^$|":
            literal = ch
        if literal is not None and depth == 0:
            run += literal
        else:
            runs.append(run)
            run = ""
        i += 1
    best = [max(texts, key=len).lower() for texts in [*branches, [*runs, run]]]
    return best if all(len(text) >= 2 and text.isascii() for text in best) else None
