"""Constant relations: surfaces, rewrite rules, managed areas and files."""

from __future__ import annotations

# Target trees and the literal rewrites of their texts, in order.
SURFACES = (".cursor", ".opencode", ".github", ".agents")
REWRITES = {
    "cursor": [(".claude/skills/", ".cursor/skills/")],
    "opencode": [(".claude/skills/", ".opencode/skills/")],
    "github": [(".claude/skills/", ".github/skills/"), (".claude/commands/", ".github/prompts/"), (".claude/rules/", ""), (".claude/", "")],
    "inline_rules": [(".claude/skills/", ".github/skills/"), (".claude/commands/", ".github/prompts/"), (".claude/rules/", ""), ("rules/", ""), (".claude/", "")],
    "agents": [(".claude/skills/", ".agents/skills/"), (".claude/commands/", ".agents/skills/"), (".claude/rules/", ""), (".claude/", ".agents/")],
}
# Directories that are replaced as a whole, and single files.
AREAS = (".cursor/commands", ".cursor/skills", ".cursor/scripts", ".opencode/commands", ".opencode/skills", ".opencode/scripts", ".github/prompts", ".github/skills", ".github/scripts", ".agents/skills", ".agents/scripts")
MANAGED_FILES = ("AGENTS.md", ".github/copilot-instructions.md", ".cursor/pixi.toml", ".cursor/pixi.lock", ".opencode/pixi.toml", ".opencode/pixi.lock", ".github/pixi.toml", ".github/pixi.lock", ".agents/pixi.toml", ".agents/pixi.lock")
