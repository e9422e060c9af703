"""Relational operators over tokens, trees and scores."""
